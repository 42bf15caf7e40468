import json

import numpy as np
import pytest

from koine.audio.metrics import encode_wav
from koine.cli import main
from koine.plans import build as b
from koine.sources import tables

RATE = 8000


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "clips").mkdir()
    rng = np.random.default_rng(0)
    lines = ["client_id\tpath\tsentence\tup_votes\tdown_votes\tlocale"]
    for i in range(40):
        n = int(RATE * (1 + i % 3))
        y = (0.4 * np.sin(np.arange(n) * 0.2) + rng.normal(0, 0.01, n)).astype(np.float32)
        if i != 7:
            (root / "clips" / f"c{i}.wav").write_bytes(encode_wav(y, RATE) if i != 8 else b"broken")
        lines.append(f"spk{i % 5}\tc{i}.wav\tsome words {'abcdefgh'[i % 8]} number {i}\t{i % 4}\t0\ten")
    lines.append('spk1\tc1.wav\t"a quoted ""line""\nwith a break"\t2\t0\ten')
    lines.append("\tc2.wav\tno client\t2\t0\ten")
    (root / "validated.tsv").write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode() + b"\n")
    return root


@pytest.fixture
def config(corpus, tmp_path):
    return b.Config(tsv=str(corpus / "validated.tsv"), audio=str(corpus / "clips"), work=str(tmp_path / "work"), output=str(tmp_path / "out"), locale="en", hours=0.008,
                    chain=[{"type": "normalize", "mode": "peak", "target": -3.0}], ratios={"train": 0.6, "val": 0.2, "test": 0.2}, limits={"max_clips_per_speaker": 4}, targets={"phoneme:number": 3})


def test_tsv(spark, corpus):
    path = str(corpus / "validated.tsv")
    rows = tables.clip_tsv(spark, path)
    assert rows.columns[0] == "client_id" and rows.count() == 41
    assert rows.where("sentence like 'a quoted%'").first().sentence == 'a quoted "line"\nwith a break'
    assert tables.tsv_stats(spark, path) == {"rows_total": 42, "rows_skipped": 1, "rows_ok": 41}
    assert tables.physical_lines(spark, path) == 44
    with pytest.raises(ValueError):
        tables.clip_tsv(spark, path, skip_incomplete=False)


def test_build_and_resume(spark, config):
    manifest = b.build(spark, config)
    clips = tables.catalog_bundle(spark, f"{config.work}/catalog")["clips"]
    reasons = {r.reject_reason: r.n for r in clips.groupBy("reject_reason").agg(b.F.count("*").alias("n")).collect()}
    assert reasons["audio_missing"] == 1 and sum(n for r, n in reasons.items() if (r or "").startswith("audio_error")) == 1 and clips.count() == 41
    plan = spark.read.parquet(f"{config.work}/plans/selection_plan.parquet")
    chosen = plan.where("disposition = 'selected'").join(clips.select("clip_id", "speaker_id", "duration_sec"), "clip_id").toPandas()
    assert len(chosen) and chosen.groupby("speaker_id").size().max() <= 4
    assert (chosen.groupby("speaker_id").split.nunique() == 1).all(), "a speaker is in one split only"
    assert not set(chosen.clip_id) & {r.clip_id for r in clips.where("disposition = 'hard_rejected'").collect()}
    assert manifest["audit"]["speakers"] == []
    meta = [json.loads(x) for x in open(f"{config.output}/metadata.jsonl")]
    assert {m["clip_id"] for m in meta} == set(chosen.clip_id)
    assert len(open(f"{config.output}/piper.txt").read().splitlines()) == len(meta)
    assert set(meta[0]) == {"utt_id", "audio_path", *b.METADATA} and all(m["split"] for m in meta)
    assert {f"{m['clip_id']}.wav" for m in meta} == {p.name for p in __import__("pathlib").Path(config.output, "wavs").glob("*.wav")}
    assert sum(len(open(f"{config.output}/metadata.{s}.jsonl").readlines()) for s in ("train", "val", "test")) == len(meta)
    audit = json.load(open(f"{config.work}/audit/coverage-audit.json"))
    assert manifest["coverage"] == audit["summary"] and [f["feature"] for f in audit["features"]] == ["phoneme:number"]
    assert len(open(f"{config.work}/audit/coverage-contributions.jsonl").readlines()) == len(meta)
    assert json.load(open(f"{config.work}/audit/missing-features.json"))["missing_features"] == []
    told = json.loads(chosen.positive_contributions.iloc[0])
    assert len(told["reasons"]) == 5 and set(told["families"]) == {"phone", "biphone", "triphone"}
    again = b.build(spark, config)
    assert again["stages"]["analyze"]["skipped"] and again["stages"]["select"]["skipped"] and again["counts"] == manifest["counts"]
    config.hours = 0.004
    changed = b.build(spark, config)
    assert changed["stages"]["analyze"]["skipped"] and not changed["stages"]["select"]["skipped"]


def test_seen_speaker_protocol_and_overrides(spark, config, tmp_path):
    config.protocol = "seen_speaker"
    clips = b.sinks.fixed_columns(b.analyze(spark, config), b.CLIPS).cache()
    splits = b.plan_split(clips, config)
    assert {r.split for r in splits.collect()} == {"train"}, "each clip has a number that only its speaker says"
    names = sorted(r.clip_id for r in clips.where("disposition = 'eligible'").collect())
    path = tmp_path / "overrides.jsonl"
    path.write_text(f'# by hand\n\n{{"clip_id": "{names[0]}", "action": "hard_reject"}}\n{{"clip_id": "{names[1]}", "action": "hard_reject"}}\n{{"clip_id": "{names[1]}", "action": "force_include"}}\n{{"clip_id": "{names[2]}", "action": "force_exclude"}}\n')
    overrides = tables.overrides_jsonl(spark, str(path))
    plan = {r.clip_id: r for r in b.select(clips, splits, config, overrides).collect()}
    assert names[0] not in plan and plan[names[1]].selected_reason == "forced" and plan[names[2]].disposition == "reserve"
    path.write_text('{"clip_id": "x", "action": "wish"}\n')
    with pytest.raises(ValueError, match="line 1"):
        tables.overrides_jsonl(spark, str(path))


def test_settled_rows_are_taken_up(spark, config):
    first = b.cut(b.analyze(spark, config), "first")
    marked = first.withColumn("analyzed_at", b.F.when(b.F.col("source_row_index") % 2 == 0, "before").otherwise(b.F.col("analyzed_at")))
    marked = marked.withColumn("text_raw", b.F.when(b.F.col("source_row_index") == 4, "another text").otherwise(b.F.col("text_raw")))
    again = {r.source_row_index: r for r in b.analyze(spark, config, marked.where("source_row_index % 2 = 0")).collect()}
    assert len(again) == 41 and {n for n, r in again.items() if r.analyzed_at == "before"} == {n for n in again if n % 2 == 0 and n != 4}
    config.chain = []
    assert not any(r.analyzed_at == "before" for r in b.analyze(spark, config, marked).collect())
    index = b.cut(b.coverage_index(spark, config), "index")
    old = index.where("source_row_index < 10").withColumn("duration_sec", b.F.lit(-1.0)).withColumn("sentence", b.F.when(b.F.col("source_row_index") == 3, "other").otherwise(b.F.col("sentence")))
    got = {r.source_row_index: r.duration_sec for r in b.coverage_index(spark, config, old).collect()}
    assert len(got) == 41 and {n for n, d in got.items() if d == -1.0} == set(range(10)) - {3}
    part = b.joins.reusable_by_id(first.select("clip_id"), first.where("source_row_index < 5")).groupBy("reuse").count().collect()
    assert {r.reuse: r["count"] for r in part} == {True: 5, False: 36}


def test_gates_before_and_after(spark, config):
    config.early, config.gate = {"duration": True}, {"max_duration_sec": 1.5}
    reasons = {r.reject_reason for r in b.analyze(spark, config).collect()}
    assert "early_gate_duration" in reasons and "gate_duration" not in reasons
    config.early, config.gate, config.asr = {}, {}, {"backend": "mock", "mock_mode": "mismatch_char", "max_cer": 0.01}
    rows = b.analyze(spark, config).collect()
    assert {r.reject_reason for r in rows} == {"asr_cer", "audio_missing", "audio_error: EOFError"} or sum(r.reject_reason == "asr_cer" for r in rows) == 39
    config.asr["mock_mode"], config.reading = "echo", "words"
    usable = b.analyze(spark, config).where("reject_reason is null").collect()
    assert len(usable) == 39 and all("|" in r.phonemes.split() and "|" not in r.biphones[0] and r.feature_source == "words" for r in usable)


def test_policy_of_coverage(spark, config):
    config.targets = {"phoneme:nowhere": 2}
    clips = b.cut(b.analyze(spark, config), "clips")
    plan = b.cut(b.select(clips, b.plan_split(clips, config), config), "plan")
    summary, missing = b.coverage_reports(clips, plan, config, f"{config.work}/audit")
    assert summary == {"not_present_in_index": 1} and missing == 1
    config.coverage_policy = "fail"
    with pytest.raises(ValueError, match="1 features"):
        b.coverage_reports(clips, plan, config, f"{config.work}/audit")
    config.coverage_policy = "no"
    with pytest.raises(ValueError):
        config.lint()


def test_rescue_and_second_pass(spark, config):
    config.gate = {"max_duration_sec": 1.5}
    config.rescue = [{"type": "resample", "target": 4000}, {"type": "trim_silence"}]
    few = b.analyze(spark, config)
    assert few.where("reject_reason = 'gate_duration'").count() > 20
    files = tables.audio_files(spark, config.audio).where("path like '%c1.wav' or path like '%c2.wav'")
    rows = files.selectExpr("path as clip_id", "content", "'some words' as text_norm", "50.0 as quality_score")
    out = {r.clip_id[-6:]: r for r in b.secondary(rows, [{"type": "normalize"}], b.quality.Gate(max_duration_sec=2.5)).collect()}
    assert out["c1.wav"].reject_reason is None and out["c2.wav"].reject_reason == "secondary_gate_duration" and out["c1.wav"].primary_quality_score == 50


def test_cli(spark, config, tmp_path, capsys):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(vars(config)))
    assert main(["scan", "--config", str(path)]) == 0
    assert json.loads(capsys.readouterr().out)["rows_ok"] == 41
    for command in ("analyze", "plan-split", "select", "materialize", "audit", "browse"):
        assert main([command, "--config", str(path)]) == 0
    assert main(["text-normalize", "--text", "Ｈｅｌｌｏ　 world..."]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "Hello world."
    assert main(["dataset-partition", "--input", f"{config.output}/metadata.jsonl", "--output", str(tmp_path / "parts"), "--group-by", "split__tier"]) == 0
    assert main(["report", "--config", str(path), "--output", str(tmp_path / "r.html")]) == 0
    assert "audio_missing" in (tmp_path / "r.html").read_text()
    for layout in ("piper", "style-bert", "ljspeech"):
        assert main(["export-trainer", "--config", str(path), "--layout", layout, "--output", str(tmp_path / layout)]) == 0 and (tmp_path / layout).read_text()
    assert main(["phoneme-manifest", "--config", str(path), "--output", str(tmp_path / "phones")]) == 0
    assert tables.phoneme_manifest(spark, str(tmp_path / "phones")).count() == 40, "two rows share a path"
    assert main(["coverage-index", "--config", str(path), "--output", str(tmp_path / "index")]) == 0
    index = tables.index_jsonl(spark, str(tmp_path / "index"))
    assert index.count() == 41 and index.where("invalidated").count() == 1 and index.where("not cheap_quality.decode_ok").count() == 2
    path.write_text(json.dumps(vars(config) | {"work": str(tmp_path / "fresh"), "targets": {"phoneme:number": 3}}))
    capsys.readouterr()
    assert main(["coverage-plan", "--config", str(path), "--input", str(tmp_path / "index")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["deficits"][0]["deficit"] == 3 and len(shown["batch"]) == 3
    assert main(["coverage-run", "--config", str(path), "--input", str(tmp_path / "index")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["stop"] == "complete" and shown["accepted"] >= 3
    assert main(["coverage-report", "--config", str(path), "--input", str(tmp_path / "index"), "--output", str(tmp_path / "standing.csv")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["features"][0]["status"] == "satisfied" and shown["top_reasons"] == [] and "phoneme:number" in (tmp_path / "standing.csv").read_text()
    assert main(["phonemize", "--text", "Ab Cd"]) == 0 and capsys.readouterr().out.splitlines()[-1] == "ab | cd"
    path.write_text(json.dumps(vars(config)))
    assert main(["metadata-jsonl-to-validated-tsv", "--input", f"{config.output}/metadata.jsonl", "--output", str(tmp_path / "again.tsv")]) == 0
    assert tables.clip_tsv(spark, str(tmp_path / "again.tsv")).count() == len(open(f"{config.output}/metadata.jsonl").readlines())
    assert main(["secondary", "--config", str(path), "--input", config.output, "--output", str(tmp_path / "second")]) == 0
    assert json.loads(capsys.readouterr().out)["passed"] == len(open(tmp_path / "second" / "metadata.jsonl").readlines())
    assert main(["preprocess", "--config", str(path)]) == 0 and json.loads(capsys.readouterr().out)["rejected"]["audio_missing"] == 1
    assert spark.read.option("header", True).csv(f"{config.work}/rejects").count() == 2
    with pytest.raises(ValueError):
        bad = tmp_path / "bad.json"
        bad.write_text('{"no_such": 1}')
        b.Config.from_file(str(bad))
