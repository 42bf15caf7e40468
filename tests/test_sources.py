import json

import pytest

from koine.sinks.versioned import Catalog
from koine import sinks
from koine.schema import CLIPS
from koine.sources import tables


def test_aligner_formats(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text('item [1]:\n class = "IntervalTier"\n name = "words"\n intervals [1]:\n text = "hey"\nitem [2]:\n class = "IntervalTier"\n name = "a - phones"\n intervals [1]:\n text = "h"\n intervals [2]:\n text = "sil"\n intervals [3]:\n text = "e"\n intervals [4]:\n text = ""\n')
    assert tables.textgrid_phones(spark, str(tmp_path / "*.TextGrid")).first().phones == ["h", "e"]
    (tmp_path / "a.ctm").write_text("u 1 0.0 0.1 h 1 x y\nshort line\nu 1 0.1 0.2 e 1 x y z\n")
    assert tables.ctm_tokens(spark, str(tmp_path / "*.ctm")).first().tokens == ["h", "e"]
    (tmp_path / "map.yaml").write_text("# map\na: b c\n'x': null\ny: \"z\" # note\n")
    assert tables.token_map(str(tmp_path / "map.yaml")) == {"a": "b c", "x": "", "y": "z"}


def test_manifests(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"source_path": "a", "phonemes": "x"}\n\n{"source_path": "a", "phonemes": "y"}\n')
    assert [tuple(r) for r in tables.phoneme_manifest(spark, str(p)).select("source_path", "phonemes").collect()] == [("a", "y")]
    p.write_text('{"source_path": "a"}\n')
    with pytest.raises(ValueError):
        tables.phoneme_manifest(spark, str(p))
    p.write_text('\n{"clip_id": "1"}\n[1]\n{"utt_id": "2"}\n')
    (tmp_path / "metadata.jsonl").write_text(p.read_text())
    assert {r.clip_id for r in tables.selected_ids(spark, str(tmp_path)).collect()} == {"1", "2"}


def test_bundle_and_publish(spark, tmp_path):
    clips = spark.createDataFrame([("c1", "s", 1.0)], "clip_id string, speaker_id string, duration_sec double").selectExpr("*", "1 as extra")
    folder = str(tmp_path / "catalog")
    for _ in range(2):
        sinks.catalog_bundle(folder, {"clips": clips})
    back = tables.catalog_bundle(spark, folder)["clips"]
    assert back.columns == CLIPS.fieldNames() and back.first().clip_id == "c1" and back.first().moras is None
    spark.createDataFrame([("c2",)], "clip_id string").write.parquet(str(tmp_path / "old.parquet"))
    assert tables.catalog_clips(spark, str(tmp_path / "old.parquet")).first().duration_sec is None


def test_training_layouts(spark, tmp_path):
    rows = spark.createDataFrame([("b", "s1", "x|y\nz", "raw"), ("a", "s1", " ", "only raw"), ("c", "s1", None, " "), (None, "s1", "t", "t")], "clip_id string, speaker_id string, text_norm string, text_raw string")
    assert [r.value for r in sinks.piper(rows).collect()] == ["a|only raw", "b|x y z"]
    two = rows.unionByName(spark.createDataFrame([("d", "s2", "t", "t")], rows.schema))
    assert sinks.piper(two).first().value == "a|s1|only raw"
    assert sinks.style_bert(rows).first().value == "a.wav|s1|JP|only raw"
    assert sinks.ljspeech_metadata(rows.where("clip_id = 'b'")).first().value == "b|raw|x y z"
    sinks.one_file(sinks.piper(rows), str(tmp_path / "list"))
    assert (tmp_path / "list").read_text() == "a|only raw\nb|x y z\n"
    (tmp_path / "src.wav").write_bytes(b"1")
    for mode in ("copy", "hardlink", "symlink"):
        sinks.place_audio(spark.createDataFrame([("k", str(tmp_path / "src.wav"))], "clip_id string, source string"), str(tmp_path / "wavs"), mode)
        assert (tmp_path / "wavs" / "k.wav").read_bytes() == b"1"


def test_partitions_and_reports(spark, tmp_path):
    from koine.operators.filters import partition_bucket, partition_filter

    rows = spark.createDataFrame([("a", "A", "train", 80.0), ("b", None, None, None), ("c", "b", "test", 50.0)], "clip_id string, quality_tier string, split string, quality_score double")
    assert sinks.partitioned(rows, str(tmp_path / "p"), partition_bucket("split__tier")) == {"train__A": 1, "unknown__UNKNOWN": 1, "test__B": 1}
    assert (tmp_path / "p" / "bucket=train__A").exists()
    assert {r.clip_id for r in partition_filter(rows, min_quality=60).collect()} == {"a"}
    assert {r.clip_id for r in partition_filter(rows, tiers=["unknown", "B"]).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        partition_bucket("nothing")
    assert "| a | 1 |" in sinks.markdown_report("t", {"x": [{"k": "a", "n": 1}], "y": []}) and "<td>a</td>" in sinks.html_report("t", {"x": [{"k": "a"}]})
    sinks.report_csv(str(tmp_path / "r.csv"), [])
    assert (tmp_path / "r.csv").read_text() == ""
    sinks.append_jsonl(str(tmp_path / "l.jsonl"), [{"a": 1}])
    assert json.loads((tmp_path / "l.jsonl").read_text()) == {"a": 1}


def test_streams(spark, tmp_path):
    from koine.streaming import progress

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"job_id":"j","ts":"2024-01-01T00:00:01Z","stage":"scan","status":"running","done":1,"total":2}\n{"job_id":"j","ts":"2024-01-01T00:00:02Z","stage":"scan","status":"done","done":2,"total":2}\n')
    events = progress.progress_stream(spark, str(tmp_path / "in"))
    q = progress.latest(events).writeStream.outputMode("complete").format("memory").queryName("latest_jobs").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.job_id, r.status, r.done) for r in spark.table("latest_jobs").collect()] == [("j", "done", 2)]
    q = progress.event_counts(events).writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.status, r.n) for r in spark.table("counts").collect()} == {("running", 1), ("done", 1)}

    schema = "clip_id string, disposition string, analyzed_at string"
    (tmp_path / "clips").mkdir()
    clips = spark.readStream.schema(schema).json(str(tmp_path / "clips"))
    for n, lines in enumerate((['{"clip_id":"a","disposition":"eligible","analyzed_at":"1"}'], ['{"clip_id":"a","disposition":"reserve","analyzed_at":"2"}', '{"clip_id":"b","disposition":"eligible","analyzed_at":"2"}'])):
        (tmp_path / "clips" / f"{n}.json").write_text("\n".join(lines))
        progress.upsert_catalog(clips, str(tmp_path / "table"), str(tmp_path / "cp"), clips.schema).awaitTermination()
    assert {(r.clip_id, r.disposition) for r in Catalog(spark, str(tmp_path / "table"), clips.schema).read().collect()} == {("a", "reserve"), ("b", "eligible")}


def test_plans_manifests_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "clip_id string, split string")
    sinks.split_plan(str(tmp_path / "plan"), "seen_speaker", rows, {"train": 0.5, "test": 0.5}, ["w"])
    settings, table = tables.split_plan(spark, str(tmp_path / "plan"))
    assert settings == {"protocol": "seen_speaker", "assigns": "clip", "ratios": {"train": 0.5, "test": 0.5}, "warnings": ["w"]} and sorted(map(tuple, table.collect())) == [("a", "train"), ("b", "test")]
    assert tables.run_manifest(str(tmp_path)) == {}
    (tmp_path / "catalog").mkdir()
    (tmp_path / "catalog" / "manifest.json").write_text('{"a": 1}')
    assert tables.run_manifest(str(tmp_path)) == {"a": 1}
    (tmp_path / "run_manifest.json").write_text('{"b": 2}')
    assert tables.run_manifest(str(tmp_path)) == {"b": 2}
    jobs = spark.createDataFrame([(f"j{i}", i % 5, i) for i in range(12)], "job_id string, created_at long, id long")
    assert [r.job_id for r in tables.newest_first(jobs, 1, 2).collect()] == ["j4", "j8"]
    assert [r.id for r in tables.progress_after(jobs, 7, 3).collect()] == [8, 9, 10]


def test_ljspeech_lines(spark):
    rows = spark.createDataFrame([("b", "b.wav", "x\ty", None), ("a", "a.wav", "n", "r\nr")], "clip_id string, audio_path string, text_norm string, text_raw string")
    assert [r.value for r in sinks.ljspeech(rows).collect()] == ["a.wav\tn\tr r", "b.wav\tx y\tx y"]
    with pytest.raises(ValueError):
        sinks.ljspeech(rows.withColumn("text_norm", tables.F.lit(None).cast("string")))
    assert sinks.left_out(rows.withColumn("text_norm", tables.F.lit(" ")).withColumn("text_raw", tables.F.lit(None).cast("string"))) == {"without a text": 2}


def test_a_catalog_that_cannot_be_read_is_no_new_catalog(spark, tmp_path):
    from koine.streaming import progress

    schema = CLIPS
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "2024")], "clip_id string, analyzed_at string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    (tmp_path / "catalog.parquet").mkdir()
    (tmp_path / "catalog.parquet" / "part.parquet").write_text("broken")
    stream = sinks.fixed_columns(spark.readStream.schema("clip_id string, analyzed_at string").parquet(str(tmp_path / "in")), schema)
    with pytest.raises(Exception):
        progress.upsert_catalog(stream, str(tmp_path / "catalog.parquet"), str(tmp_path / "check"), schema).awaitTermination()
    assert (tmp_path / "catalog.parquet" / "part.parquet").read_text() == "broken"
