import hashlib
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from koine import sinks
from koine.audio import align
from koine.functions import backends
from koine.operators import aggregates as agg
from koine.plans import build as b
from koine.plans import queries as core
from koine.sources import tables
from tests.test_build import RATE, config, corpus  # noqa: F401


def test_samples_are_the_same_for_every_partitioning(spark):
    rows = [("hot", f"c{i}", i) for i in range(300)] + [("b", "x", 1), ("b", "x", 1), ("b", None, 2), (None, "n", 3)]
    df = spark.createDataFrame(rows, "reason string, clip_id string, place int")
    want = {}
    for reason, c, _ in rows:
        if c is not None:
            want.setdefault(reason, []).append(c)
    want = {r: sorted(cs, key=lambda c: (hashlib.md5(f"7:{c}".encode()).hexdigest(), c))[:4] for r, cs in want.items()}
    for n in (1, 3, 16):
        got = {}
        for r in agg.samples_by(df.repartition(n), "reason", "clip_id", most=4, seed=7).orderBy("reason", "place").collect():
            got.setdefault(r.reason, []).append(r.clip_id)
        assert got == want
    assert agg.samples_by(df.limit(0), "reason", "clip_id").count() == 0


def test_few_rows_of_a_hot_group_are_shuffled(spark):
    df = spark.range(1000).select(F.expr("if(id = 5, 'cold', 'hot')").alias("reason"), F.col("id").cast("string").alias("clip_id"))
    plan = agg.samples_by(df, "reason", "clip_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "one before the exchange, one after"


def test_scan_warnings():
    assert agg.scan_warnings(False, 5, False, 5, 5, 6) == []
    assert len(agg.scan_warnings(True, 0, True, 0, 5, 9)) == 3
    assert agg.scan_warnings(False, 0, True, 0, 0) == []


def test_one_file_keeps_the_order(spark, tmp_path):
    df = spark.range(500).repartition(7).select(F.format_string("%04d ä", "id").alias("value")).orderBy("value")
    sinks.one_file(df, str(tmp_path / "list"))
    assert (tmp_path / "list").read_text(encoding="utf-8") == "".join(f"{i:04d} ä\n" for i in range(500)) and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("packaging", ["single_model", "per_speaker"])
def test_packs(spark, tmp_path, packaging):
    (tmp_path / "a.wav").write_bytes(b"sound")
    rows = [(f"c{i:03d}", ["sp/1", "sp 2", "日本", None][i % 4], f"text|{i}", "raw", str(tmp_path / "a.wav")) for i in range(90)] + [("zz", "sp/1", " ", None, "nowhere")]
    df = spark.createDataFrame(rows, "clip_id string, speaker_id string, text_norm string, text_raw string, source string").repartition(5)
    out = tmp_path / "out"
    counts = sinks.style_bert_packs(df, str(out), packaging, model="m")
    names = {"sp/1": "sp_1", "sp 2": "sp_2", "日本": "日本", None: "unknown"}
    want = {}
    for c, s, t, _, _ in rows[:-1]:
        want.setdefault(names[s] if packaging == "per_speaker" else "m", []).append(f"{c}.wav|{s or ''}|JP|{t.replace('|', ' ')}")
    assert counts == {k: len(v) for k, v in want.items()}
    for name, lines in want.items():
        folder = out / "Data" / name
        assert (folder / "esd.list").read_text(encoding="utf-8").splitlines() == lines
        assert sorted(p.name for p in (folder / "raw").iterdir()) == [x.split("|")[0] for x in lines] and (folder / "raw" / lines[0].split("|")[0]).read_bytes() == b"sound"
    assert [p.name for p in out.iterdir()] == ["Data"]
    with pytest.raises(ValueError):
        sinks.style_bert_packs(df, str(out), "other")


def test_normalised_texts_in_their_own_scripts(spark, tmp_path):
    texts = ["Ｈｅｌｌｏ　 world", "ｶﾞｷﾞ ① ﬁ", "日本語　テスト", "", None, "x" * 5000 + " y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.sha256 for r in core.normalized_text_whole(spark, str(tmp_path)).collect()}
    plain = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]
    assert got == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(plain)}


def rows_of(spark, config):  # noqa: F811
    return {r.normalized_relative_source_path: r for r in b.analyze(spark, config).collect()}


def test_what_was_heard_is_written_back(spark, config, monkeypatch):  # noqa: F811
    monkeypatch.setitem(backends.TRANSCRIBERS, "hears", lambda contents: ["some words heard here" for _ in contents])
    config.asr = {"backend": "hears", "max_cer": 0.9, "length_ratio": None}
    kept = rows_of(spark, config)
    assert kept["c0.wav"].text_norm == "some words a number 0" and kept["c0.wav"].phonemes == "some words a number 0"
    config.asr |= {"sync_text": True}
    synced = rows_of(spark, config)
    assert synced["c0.wav"].text_norm == "some words heard here" and synced["c0.wav"].phonemes == "some words a number 0"
    assert synced["c7.wav"].reject_reason == "audio_missing" and synced["c7.wav"].text_norm == "some words h number 7"
    config.asr |= {"sync_text": False, "hypothesis_phonemes": True}
    read = rows_of(spark, config)
    assert read["c0.wav"].text_norm == "some words a number 0" and read["c0.wav"].phonemes == "some words heard here"
    config.reading = "broken"
    monkeypatch.setitem(backends.READINGS, "broken", lambda t: None if "heard" in t else t)
    assert rows_of(spark, config)["c0.wav"].reject_reason == "asr_hypothesis_phonemize_failed"


def test_alignment_as_a_stage(spark, config, monkeypatch):  # noqa: F811
    words = ("", "some", "words", "number", *"abcdefgh", *map(str, range(0, 40, 2)))

    def model(samples, rates):
        """A word a tenth of a second, in the order of the list; the sixth of them is never heard."""
        return [np.full((len(y) * 10 // RATE, len(words)), -0.5) + np.where(np.arange(len(words)) == 6, -9.0, 0.0) for y in samples]

    monkeypatch.setitem(align.EMISSIONS, "flat", (model, words, 0.1))
    config.aligner = {"backend": "flat"}
    rows = rows_of(spark, config)
    assert rows["c0.wav"].reject_reason is None and rows["c4.wav"].reject_reason is None
    assert rows["c3.wav"].reject_reason == "nfa_token_mismatch", "3 isn't among the model's words"
    assert rows["c2.wav"].reject_reason is None
    config.aligner = {"backend": "flat", "min_score": -5.0}
    strict = rows_of(spark, config)
    assert strict["c2.wav"].reject_reason == "nfa_token_mismatch", "its letter isn't heard" and strict["c0.wav"].reject_reason is None
    config.aligner |= {"max_rate": 0.25}
    assert rows_of(spark, config)["c2.wav"].reject_reason is None
    assert rows["c7.wav"].reject_reason == "audio_missing"
