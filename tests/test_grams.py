"""Runs of neighbours counted by what follows each pair, and reports that count once."""

import math
import unicodedata
from collections import Counter

import pyarrow as pa

from koine import scratch
from koine.functions import text, tokens
from koine.operators import aggregates as agg
from koine.operators import filters, grams, reports, selection


def test_runs_are_counted_as_strings(spark):
    """Tokens that hold the glue make runs that read alike: they count as one."""
    lists = [["a", "b", "c", "a", "b", "c"], ["a-b", "c"], ["a", "b-c"], ["a", "b-c", "d"], ["a-b", "c", "d"], ["-", "-"], ["x"], [], None, ["a", "b"], ["-", "a", "b", "-"]]
    got = {(r.family, r.token): r["count"] for r in agg.gram_counts(spark.createDataFrame([(x,) for x in lists], "phones array<string>")).collect()}
    want = Counter((name, "-".join(x[i : i + n])) for x in lists if x for n, name in ((2, "biphone"), (3, "triphone")) for i in range(len(x) - n + 1))
    assert got == want and got["biphone", "a-b-c"] == 4


def test_summary_of_counts_reads_them_once(spark):
    counts = spark.createDataFrame([("f", "a", 1), ("f", "b", 3), ("f", "c", 3), ("g", "a", 5)], "family string, token string, count long")
    out = reports.coverage_summary(counts.repartition(3))
    got = {r.family: r for r in out.collect()}
    m = [(x / 7 + 1 / 3) / 2 for x in (1, 3, 3)]
    want = math.sqrt(sum(x / 7 * math.log(x / 7 / y) + math.log(1 / 3 / y) / 3 for x, y in zip((1, 3, 3), m)) / 2)
    assert (got["f"].tokens, got["f"].occurrences, got["g"].js_distance) == (3, 7, 0) and abs(got["f"].js_distance - want) < 1e-12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_counts_of_catalog_families(spark):
    rows = [("c1", "s", "a b a", ["x"], ["l"]), ("c2", None, "a b", ["x", "x"], [None, "l"]), ("c3", "s", "", [], [])]
    clips = spark.createDataFrame(rows, "clip_id string, speaker_id string, phonemes string, moras array<string>, fullcontext_labels array<string>")
    clips = clips.withColumn("phones", agg.split_tokens(agg.F.col("phonemes"))).withColumns({f"{n}phones": tokens.ngrams(agg.F.col("phones"), k) for n, k in (("bi", 2), ("tri", 3))})
    key = lambda df: sorted(map(str, df.collect()))
    got = agg.catalog_feature_counts(clips)
    assert key(got) == key(agg.feature_counts(agg.incidence(clips, agg.catalog_families())))
    assert {(r.feature_type, r.feature): (r["count"], r.speaker_count, r.utterance_count) for r in got.collect()}["biphone", "a-b"] == (2, 2, 2)


def test_large_keys_alone_take_the_written_sort(spark, monkeypatch):
    """Keys of few rows are summed by windows though another key has many."""
    monkeypatch.setattr(scratch, "WINDOW_ROWS", 50)
    sorted_rows, placed = [], scratch.placed
    monkeypatch.setattr(scratch, "placed", lambda df, order: sorted_rows.append(df.count()) or placed(df, order))
    rows = [(None if i < 60 else "hot" if i < 130 else f"k{i % 7}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = {r.i: r.n for r in scratch.summed_before(df, ["k"], [agg.F.col("i")], agg.F.col("i"), "n").collect()}
    assert got == {i: sum(j for h, j in rows if h == k and j < i) for k, i in rows} and sorted_rows == [130]
    lists = {(r.k, r.part): r["items"] for r in scratch.chunked(df, ["k"], "i", 40).collect()}
    assert lists[None, 1] == list(range(40, 60)) and lists["hot", 0] == list(range(60, 100)) and sum(map(len, lists.values())) == 200


def test_pairs_are_counted_where_they_are_made(spark, tmp_path):
    """One shuffle of whole lists (and one that deals the table anew), none of pairs."""
    import __spark_entry__ as entry

    plan = entry.queries()["proportional_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(clip_id") == 1 and "hashpartitioning(clip_id#" in plan and "src" not in plan.split("hashpartitioning(clip_id")[1].split("\n")[0]


def test_coverage_by_feature_is_one_pass(spark):
    """Against the operators that count distinct ids; a missing speaker counts as none there too."""
    rows = [(f"c{i}", None if i % 5 == 0 else f"s{i % 4}", i, "eligible" if i % 3 else None if i % 2 else "hard_rejected", [f"f{k}" for k in range(8) if (i * 7 + k) % 4 == 0]) for i in range(60)]
    clips = spark.createDataFrame(rows, "clip_id string, speaker_id string, i int, disposition string, feature_keys array<string>")
    eligible, selected = filters.counted(agg.F.col("disposition")), agg.F.col("i") % 3 == 1
    got = agg.coverage_by_feature(clips, eligible, selected)
    keys = clips.where(eligible).select("clip_id", "speaker_id", agg.F.explode("feature_keys").alias("feature"))
    targets = clips.select(agg.F.explode("feature_keys").alias("feature")).distinct().select("feature", agg.F.lit(2).alias("minimum"), agg.F.lit(3).alias("desired"), agg.F.lit(True).alias("required"))
    want = selection.coverage_constraints(targets, keys, agg.coverage_counts(clips)).join(agg.selected_coverage(keys, clips.where(selected)), "feature", "left")
    want = want.na.fill(0, ["selected_count", "selected_speaker_count"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString() and "clip_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_first_scores_of_distinct_tokens(spark):
    rows = spark.createDataFrame([("c", "f", "a"), ("c", "f", "b"), ("d", "f", "a")], "clip_id string, family string, token string")
    targets = spark.createDataFrame([("f", "a", 0.25), ("f", "b", 0.75)], "family string, token string, target double")
    twice = selection.first_scores(rows.unionByName(rows), targets).collect()
    assert sorted(map(tuple, selection.first_scores(rows, targets, distinct=True).collect())) == sorted(map(tuple, twice))


def test_compatibility_forms_are_unpacked_a_few_at_a_time(spark):
    seen, normalize = [], unicodedata.normalize
    texts = [None, "", "plain", "ﬁ Ａ", "é"] * 40
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.compatible(agg.F.col("t"))).collect()]
    assert got == [None if t is None else normalize("NFKC", t) for t in texts]

    class Slices:
        def __len__(self):
            return 150

        def slice(self, i, n):
            seen.append(n)
            return pa.array(["ﬁ"] * min(n, 150 - i))

    assert text.nfkc_udf.func(Slices()).to_pylist() == ["fi"] * 150 and seen == [text.STEP] * 3


def test_shares_of_a_family_are_not_dealt_by_family(spark):
    counts = spark.createDataFrame([("f", f"t{i}", i) for i in range(9)] + [("g", "x", 4)], "family string, token string, count long")
    out = agg.target_distribution(counts)
    assert {r.token: r.target for r in out.collect()}["x"] == 1.0
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_tokens_of_one_family_are_unpacked_once(spark):
    clips = spark.createDataFrame([("c", "s", ["a", "b", "a"]), ("d", None, []), ("e", "s", None)], "clip_id string, speaker_id string, phones array<string>")
    rows = agg.incidence(clips, {"phone": agg.F.col("phones")}, False)
    assert sorted(map(tuple, rows.collect())) == [("c", "s", "phone", "a"), ("c", "s", "phone", "a"), ("c", "s", "phone", "b")]
    assert rows._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1


def test_runs_travel_as_numbers_of_words(spark, monkeypatch):
    """The same counts for any share of words with a number, any lot and any number of buckets; few strings are shuffled."""
    import random

    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", "f-g", "-", "\u00e9", ""]
    rows = [(f"c{i}", rng.choice([None, "s", "t", ""]), [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))]) for i in range(60)] + [("n", "s", None)]
    clips = spark.createDataFrame(rows, "clip_id string, speaker_id string, phones array<string>").repartition(3)
    seen: dict = {}
    for clip, speaker, phones in rows:
        for n, name in ((2, "biphone"), (3, "triphone")):
            for i in range(len(phones or []) - n + 1):
                of = seen.setdefault((name, "-".join(phones[i : i + n])), [0, set(), set()])
                of[0], of[1], of[2] = of[0] + 1, of[1] | {speaker or ""}, of[2] | {clip}
    want = {k: (n, len(s), len(c)) for k, (n, s, c) in seen.items()}
    counts = clips.select(agg.F.explode("phones").alias("token")).groupBy("token").agg(agg.F.count("*").alias("count"))
    for known, step, places in ((1_000_000, 2_000_000, 1_000_000), (3, 7, 50), (0, 100, 200)):
        monkeypatch.setattr(grams, "WORDS", known)
        monkeypatch.setattr(grams, "STEP", step)
        monkeypatch.setattr(grams, "PLACES", places)
        got = grams.runs(clips, counts, "phones", ("biphone", "triphone"), "-", "speaker_id").collect()
        assert {(r.family, r.token): (r["count"], r.speaker_count, r.utterance_count) for r in got} == want and len(got) == len(want)
        plain = agg.gram_counts(clips).collect()
        assert {(r.family, r.token): r["count"] for r in plain} == {k: n for k, (n, _, _) in want.items()} and len(plain) == len(want)


def test_counts_of_runs_are_written_packed(spark, monkeypatch):
    """target_distribution reads its counts twice: what is written for it has runs as numbers, and as strings only those of a
    word that holds the glue."""
    import __spark_entry__ as entry

    written, cut = [], scratch.cut

    def told(df, name):
        written.append(cut(df, name))
        return written[-1]

    for module in (scratch, agg, grams):
        monkeypatch.setattr(module, "cut", told, raising=False)
    out = entry.queries()["target_distribution"](spark, "/root/testdata/sf0.001")
    runs = out.where("family in ('biphone', 'triphone')").count()
    strings = [t.where("family in ('biphone', 'triphone')" if "family" in t.columns else "token is not null").count() for t in written if "token" in t.columns]
    assert runs > 1000 and strings and sum(strings) < runs / 4
