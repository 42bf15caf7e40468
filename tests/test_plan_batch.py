"""Batches planned in rounds against the greedy batch of all candidates in one list."""

import random

import pytest
from pyspark.sql import Row

from koine.operators import coverage as cov
from koine.schema import INDEX

TARGETS = "feature string, minimum long, desired long, required boolean"


def index_of(spark, n, seed, same=False):
    rng, good = random.Random(seed), Row(decode_ok=True, peak=0.5, rms=0.1, clipping_ratio=0.0, silence_ratio=0.1)
    rows = []
    for i in range(n):
        keys = ["phoneme:a"] if same else [f"phoneme:{rng.choice('abcdefghijkl')}" for _ in range(3)]
        rows.append((f"c{i:03}", None, i, None if i % 11 == 0 else f"s{rng.randrange(5)}", None, "" if i % 5 == 0 else f"t{rng.randrange(12)}", 2.0 if same else rng.random() * 5, 0, 0, None, keys, good, i % 13 == 0))
    return spark.createDataFrame(rows, INDEX)


def planned(spark, index, working_set, size, targets=None, config=cov.PlannerConfig()):
    rng = random.Random(1)
    wanted = spark.createDataFrame(targets if targets is not None else [(f"phoneme:{c}", n := rng.randint(1, 9), n, i % 2 == 0) for i, c in enumerate("abcdefgh")], TARGETS)
    counts = spark.createDataFrame([("phoneme:a", 1), ("phoneme:b", 3)], "feature string, count long")
    done = spark.createDataFrame([("c001",)], "clip_id string")
    stats = spark.createDataFrame([("s0", 10, 4), ("s1", 5, 5)], "speaker_id string, attempts long, passes long")
    return [tuple(r) for r in cov.plan_batch(index, wanted, counts, done, stats, config, size, working_set).orderBy("rank").collect()]


def test_working_sets_give_the_batch_of_all(spark):
    index, config = index_of(spark, 90, 3), cov.PlannerConfig(max_per_speaker=4)
    whole = planned(spark, index, 1000, 15, config=config)
    assert len(whole) == 15 and [r for r, _, _ in whole] == list(range(1, 16))
    for n in (2, 9):
        some = planned(spark, index, n, 15, config=config)
        assert [c for _, c, _ in some] == [c for _, c, _ in whole]
        assert [s for _, _, s in some] == pytest.approx([s for _, _, s in whole])


def test_scores_after_a_batch_are_those_of_the_pick(spark):
    """What Spark scores after each of the first picks is led by the next one, at its score."""
    clips = spark.createDataFrame([(f"c{i}", f"s{i % 3}", "t" if i % 2 else None, 0.5 + i / 20) for i in range(8)], "clip_id string, speaker string, text string, rate double")
    rows = [(f"c{i}", f"f{k}", 1 + k, 0.1 * (1 + k)) for i in range(8) for k in range(4) if (i * 3 + k) % 4 < 2]
    held = spark.createDataFrame(rows, "clip_id string, feature string, deficit long, gain double")
    plain = [{**r.asDict(), "keys": [f for c, f, _, _ in rows if c == r.clip_id]} for r in clips.collect()]
    want = cov.pick_batch(plain, {f: (d, g) for _, f, d, g in rows}, 5, cov.PlannerConfig(max_per_speaker=2))
    assert len(want) == 5
    for n in range(5):
        had = spark.createDataFrame([(c,) for c, _ in want[:n]], "clip_id string")
        top = cov.scores_after(clips, held, had, cov.PlannerConfig(max_per_speaker=2)).orderBy(cov.F.desc("score"), "clip_id").first()
        assert (top.clip_id, top.score) == (want[n][0], pytest.approx(want[n][1]))


def test_gains_less_what_the_picked_clips_take_give_the_same_scores(spark):
    """Also where a clip's features are all taken, which leaves it nothing, not what rounding leaves."""
    clips = spark.createDataFrame([(f"c{i}", f"s{i}", None, 0.5) for i in range(6)], "clip_id string, speaker string, text string, rate double")
    rows = [(f"c{i}", f"f{k}", 1 + k % 2, 0.1 * (1 + k)) for i in range(6) for k in range(6) if (i + k) % 3 < 2]
    held = spark.createDataFrame(rows, "clip_id string, feature string, deficit long, gain double")
    known = clips.join(held.groupBy("clip_id").agg(cov.F.sum("gain").alias("first")), "clip_id")
    for names in ([], ["c0"], ["c0", "c1"], ["c0", "c1", "c2", "c3"]):
        had = spark.createDataFrame([(c,) for c in names], "clip_id string")
        whole, less = ({r.clip_id: r.score for r in cov.scores_after(c, held, had, cov.PlannerConfig(), *more).collect()} for c, more in ((clips, ()), (known, (True,))))
        assert less == pytest.approx(whole) and (len(names) < 4 or not less)


def test_ties_go_by_id_and_ends_are_empty(spark):
    index = index_of(spark, 12, 5, same=True)
    targets = [("phoneme:a", 4, 4, True)]
    small, whole = (planned(spark, index, n, 10, targets) for n in (1, 100))
    assert [c for _, c, _ in small] == [c for _, c, _ in whole] and len(whole) == 3, "one of the four is there already"
    assert planned(spark, index, 5, 10, []) == []
    assert planned(spark, index.limit(0), 5, 10, targets) == []
    assert planned(spark, index, 5, 0, targets) == []
