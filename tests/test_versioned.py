"""Catalogs in versions and publication: whatever is killed, the table before or the table after is there."""

import os

import pytest
from pyspark.sql import types as T

from koine import sinks
from koine.sinks import versioned
from koine.sinks.versioned import Catalog

SCHEMA = T.StructType([T.StructField("clip_id", T.StringType()), T.StructField("disposition", T.StringType()), T.StructField("analyzed_at", T.StringType())])


def rows(spark, ids, what, at):
    return spark.createDataFrame([(i, what, at) for i in ids], SCHEMA)


def test_a_merge_rewrites_its_buckets_alone(spark, tmp_path):
    table = Catalog(spark, str(tmp_path / "c"), SCHEMA, buckets=32)
    assert table.read().collect() == [] and table.merge(rows(spark, [], "x", "1")) is None
    first = table.merge(rows(spark, [f"c{i}" for i in range(1000)], "eligible", "1"))
    second = table.merge(rows(spark, ["c1", "c2", "new"], "reserve", "2").unionByName(rows(spark, ["c1"], "late", "0")))
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert len(first.folders) == 32 and 1 <= len(changed) <= 3 and second.version == 2
    got = {r.clip_id: r.disposition for r in table.read().collect()}
    assert len(got) == 1001 and got["c1"] == got["c2"] == got["new"] == "reserve" and got["c3"] == "eligible"
    assert table.read(1).count() == 1000
    same = table.merge(rows(spark, ["c1"], "reserve", "2"))
    assert {r.clip_id: r.disposition for r in table.read().collect()} == got and same.version == 3
    table.vacuum(keep=1)
    assert {r.clip_id: r.disposition for r in table.read().collect()} == got and [s.version for s in table.snapshots()] == [3]


@pytest.mark.parametrize("step", ["write", "commit", "half a snapshot"])
def test_a_kill_at_any_step_leaves_the_old_snapshot(spark, tmp_path, monkeypatch, step):
    table = Catalog(spark, str(tmp_path / "c"), SCHEMA, buckets=4)
    table.merge(rows(spark, ["a", "b"], "eligible", "1"))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(versioned, "upsert", killed)
        elif step == "commit":
            m.setattr(Catalog, "_create", killed)
        else:
            whole = Catalog._create

            def half(self, path, text):
                whole(self, path, text[: len(text) // 2])
                raise KeyboardInterrupt

            m.setattr(Catalog, "_create", half)
        with pytest.raises(KeyboardInterrupt):
            table.merge(rows(spark, ["a", "c"], "reserve", "2"))
    assert {(r.clip_id, r.disposition) for r in table.read().collect()} == {("a", "eligible"), ("b", "eligible")}
    table.merge(rows(spark, ["a", "c"], "reserve", "2"))
    assert {(r.clip_id, r.disposition) for r in table.read().collect()} == {("a", "reserve"), ("b", "eligible"), ("c", "reserve")}


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    table = Catalog(spark, str(tmp_path / "c"), SCHEMA, buckets=4)
    table.merge(rows(spark, ["a"], "eligible", "1"))
    monkeypatch.setattr(Catalog, "_next", lambda self: 1)
    with pytest.raises(versioned.Conflict):
        table.merge(rows(spark, ["b"], "eligible", "1"))


def test_publication_that_was_cut_off_is_put_right(tmp_path, monkeypatch):
    target, staging = tmp_path / "t", tmp_path / "s"
    for name, text in ((target, "old"), (staging, "new")):
        name.mkdir()
        (name / "x").write_text(text)
    real, calls = os.replace, []

    def dies(a, b):
        calls.append(a)
        if len(calls) >= 2:
            raise KeyboardInterrupt
        real(a, b)

    with monkeypatch.context() as m:
        m.setattr(os, "replace", dies)  # the process is gone between the renames: nothing is put back either
        with pytest.raises(KeyboardInterrupt):
            sinks.publish(str(staging), str(target))
    assert not target.exists() and (tmp_path / "t.old" / "x").read_text() == "old"
    with monkeypatch.context() as m:
        m.setattr(os, "replace", lambda a, b: real(a, b) if str(a).endswith(".old") else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # the next one puts the old table back before it deletes anything
            sinks.publish(str(staging), str(target))
    assert (target / "x").read_text() == "old"
    sinks.publish(str(staging), str(target))
    assert (target / "x").read_text() == "new" and not (tmp_path / "t.old").exists()


def test_recordings_of_one_name_in_two_folders(spark, tmp_path):
    from koine.audio import metrics, steps
    from koine.sources import tables

    for folder, text in (("a", b"1"), ("b", b"2"), ("b/deep", b"3")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "clip.wav").write_bytes(text)
    (tmp_path / "b" / "only one%.wav").write_bytes(b"4")
    clips = spark.createDataFrame([("a/clip.wav",), ("b\\clip.wav",), ("./b/deep/clip.wav",), ("clip.wav",), ("x/only one%.wav",), ("none.wav",), (None,)], "path string")
    found = tables.with_recordings(clips, tables.recordings(spark, str(tmp_path)))
    got = {r.path: (metrics.bytes_of(r.recording) if r.recording else None) for r in found.collect()}
    assert got == {"a/clip.wav": b"1", "b\\clip.wav": b"2", "./b/deep/clip.wav": b"3", "clip.wav": None, "x/only one%.wav": b"4", "none.wav": None, None: None}
    plan = steps.processed(found, "recording", [{"type": "normalize"}], keep=False)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("Join") :]
    assert "content" not in "".join(line for line in joins.splitlines() if "Join" in line or "Aggregate" in line)
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not any("content" in line for line in exchanges)


def test_a_worker_imports_the_package_whatever_the_drivers_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(sinks.__file__).resolve().parents[2])
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from koine.plans import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert queries.QUERIES["token_error_rate"](spark, "/root/testdata/sf0.001").count() == 200
assert queries.QUERIES["wave_snr"](spark, "/root/testdata/sf0.001").count() > 0
"""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
