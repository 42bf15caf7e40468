"""Relational operators on small tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from koine import scratch
from koine.operators import aggregates as agg
from koine.operators import filters, joins, reports, windows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbers_are_gapless_and_ordered(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 13)
    out = scratch.numbered(df, [F.desc("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 1001)) and [(-r.k, r.id) for r in out] == sorted((-r.k, r.id) for r in out)
    assert scratch.numbered(df.limit(0), ["id"], "n").count() == 0


def test_feature_counts_with_missing_speakers(spark):
    clips = spark.createDataFrame([("1", "s", "a b a"), ("2", None, "a"), ("3", None, ""), ("4", "t", None)], "clip_id string, speaker_id string, phonemes string")
    inc = agg.incidence(clips, {"phone": agg.split_tokens(F.col("phonemes"))})
    assert rows_of(agg.feature_counts(inc)) == [("phone", "a", 3, 2, 2), ("phone", "b", 1, 1, 1)]
    approx = {r.feature: r["count"] for r in agg.approximate_counts(inc).collect()}
    assert approx == {"a": 3, "b": 1}


def test_duplicate_groups(spark):
    clips = spark.createDataFrame(
        [("1", "h", "p1", "s1", "t", "x"), ("2", "h", "p2", None, "t", "y"), ("3", "", "p3", None, "", "x"), ("4", "", "p1", "s1", "t", "x")],
        "clip_id string, audio_sha256 string, normalized_relative_source_path string, sentence_id string, text_norm string, speaker_id string",
    )
    got = {(r.kind, tuple(r["items"])) for r in agg.duplicate_members(clips).collect()}
    assert got == {("exact_audio", ("1", "2")), ("same_source_path", ("1", "4")), ("same_sentence_id", ("1", "4")), ("same_normalized_text", ("1", "2", "4")), ("same_speaker_same_text", ("1", "4"))}
    groups = {r.group_id: r.size for r in agg.duplicate_groups(clips).collect()}
    assert all(len(g) == 16 for g in groups) and {r.group_id: len(r["items"]) for r in agg.duplicate_members(clips).collect()} == groups


@pytest.mark.parametrize("rows", [0, 100_000])
def test_lists_in_chunks_and_sums_before(spark, monkeypatch, rows):
    monkeypatch.setattr(scratch, "WINDOW_ROWS", rows)
    rows = [("a" if i % 3 else None, f"i{i:03}", i) for i in range(250)] + [("b", "z", 1)]
    df = spark.createDataFrame(rows, "k string, item string, n long").repartition(7)
    got = {(r.k, r.part): r["items"] for r in scratch.chunked(df, ["k"], "item", 40).collect()}
    for k in ("a", "b", None):
        items = sorted(x for key, x, _ in rows if key == k)
        assert [x for part in sorted(p for key, p in got if key == k) for x in got[k, part]] == items
    assert all(len(x) <= 40 for x in got.values()) and len(got) == 5 + 3 + 1
    sums = {(r.k, r["item"]): r.before for r in scratch.summed_before(df, ["k"], [scratch.F.col("item")], scratch.F.col("n"), "before").collect()}
    for k, x, _ in rows:
        assert sums[k, x] == sum(n for key, y, n in rows if key == k and y < x)
    assert scratch.summed_before(df.limit(0), [], [scratch.F.col("item")], scratch.F.col("n"), "before").count() == 0


def test_distances(spark):
    a = spark.createDataFrame([("f", "x", 1), ("f", "y", 1), ("g", "x", 3)], "family string, token string, count long")
    b = spark.createDataFrame([("f", "z", 5), ("g", "x", 9)], "family string, token string, count long")
    out = {r.family: r.js_distance for r in reports.js_distance(a, b, ["family"], "token", "count").collect()}
    assert out["f"] == pytest.approx(0.6931471805599453**0.5) and out["g"] == 0
    assert {r.family: r.js_distance for r in reports.js_to_uniform(a).collect()} == {"f": 0, "g": 0}


@pytest.mark.parametrize("policy, leaks", [("forbid", 3), ("forbid_for_test", 2), ("allow", 0)])
def test_leakage_policies(spark, policy, leaks):
    clips = spark.createDataFrame([("1", "train", "a"), ("2", "val", "a"), ("3", "train", "b"), ("4", "test", "b"), ("5", "test", "c"), ("6", "train", "c"), ("7", "train", None), ("8", "test", None), ("9", "train", ""), ("10", "test", "")], "clip_id string, split string, audio_sha256 string")
    found = reports.leakage(clips, {"audio": policy}, {"audio": "audio_sha256"})
    assert found.count() == leaks
    members = reports.leaking_clips(clips, found, {"audio": "audio_sha256"}).collect()
    assert len({r.key for r in members}) == leaks and sum(len(r["items"]) for r in members) == 2 * leaks


def test_joins(spark):
    clips = spark.createDataFrame([("1", "s"), ("2", "t")], "clip_id string, speaker_id string")
    with pytest.raises(ValueError, match="lacks"):
        joins.plan_with_clips(spark.createDataFrame([("9",)], "clip_id string"), clips)
    known = spark.createDataFrame([("s", "test")], "speaker_id string, split string")
    assert rows_of(joins.with_split(clips, known).select("clip_id", "split")) == [("1", "test"), ("2", "train")]
    assert rows_of(joins.with_split(clips, known, None).select("clip_id", "split")) == [("1", "test")]
    new = spark.createDataFrame([("2", "u"), ("3", "v")], "clip_id string, speaker_id string")
    assert rows_of(joins.upsert(clips, new)) == [("1", "s"), ("2", "u"), ("3", "v")]
    manifest = spark.createDataFrame([("a", "x y")], "source_path string, phonemes string")
    files = spark.createDataFrame([("a",), ("b",)], "source_path string")
    assert rows_of(joins.manifest_phonemes(files, manifest, "reject")) == [("a", "x y", None), ("b", None, "alignment_missing")]
    assert rows_of(joins.manifest_phonemes(files, manifest).select("alignment_reason").distinct()) == [(None,)]


def test_blank_cells_and_votes(spark):
    rows = spark.createDataFrame([("1", " Male ", "3"), ("2", "", "x"), ("3", None, None), ("4", "female", " 1")], "clip_id string, gender string, up_votes string")
    ids = lambda df: {r.clip_id for r in df.collect()}
    assert ids(filters.by_metadata(rows, {"gender": ["male"]})) == {"1"} and ids(filters.by_metadata(rows, {"gender": ["", "MALE"]})) == {"1", "2", "3"}
    assert ids(filters.by_metadata(rows, {}, min_up_votes=1)) == {"1", "4"} and ids(filters.by_metadata(rows, {"gender": []})) == {"1", "2", "3", "4"}


def test_votes_and_caps(spark):
    votes = spark.createDataFrame([("a", "x", 4), ("a", "y", 2), ("b", "z", 5), ("b", "w", 2), ("c", "q", 1)], "src string, dst string, votes long")
    assert rows_of(windows.vote_winners(votes).select("src", "dst", "ambiguous")) == [("a", "x", True), ("b", "z", False), ("c", "q", False)]
    rows = spark.createDataFrame([("1", "g", 0.5), ("2", "g", 0.9), ("3", "g", 0.9), ("4", None, 0.1), ("5", None, 0.2)], "clip_id string, grp string, score double")
    assert {r.clip_id for r in windows.duplicate_cap(rows, "grp", "score", 1).collect()} == {"2", "4", "5"}
    ranked = windows.reserve_ranking(rows, 0.4, 7).orderBy("reserve_rank").collect()
    assert [r.clip_id for r in ranked[:2]] == ["2", "3"] and sorted(r.clip_id for r in ranked[2:]) == ["1", "4", "5"] and [r.reserve_rank for r in ranked] == [1, 2, 3, 4, 5]
    parts = windows.random_split(spark.range(50).selectExpr("cast(id as string) as clip_id"), 0.8, 0.1, 3)
    assert rows_of(parts.groupBy("split").count()) == [("test", 5), ("train", 40), ("val", 5)]


def test_dispositions(spark):
    rows = spark.createDataFrame([(d,) for d in ("eligible", "selected", "reserve", "hard_rejected", "", None)], "d string")
    names = lambda f: {r.d for r in rows.where(f(F.col("d"))).collect()}
    assert names(filters.splittable) == {"eligible", "selected", None} and names(filters.selectable) == {"eligible", "selected", "reserve", "", None}
    assert names(filters.counted) == {"eligible", "selected"} and names(filters.accepted) == {"eligible", "selected", "reserve"}


def test_speaker_audit_slack(spark):
    rows = spark.createDataFrame([("s", 5.0), ("s", 5.0000005), ("t", 1.0)], "speaker_id string, duration_sec double")
    got = rows_of(reports.speaker_audit(rows, 1, 10.0, 2.0).select("speaker_id", "rule"))
    assert got == [("s", "max_clips"), ("t", "min_duration_sec")]
