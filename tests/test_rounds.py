"""Selection in rounds against plain greedy selection, clip by clip."""

import json
import math
from collections import Counter

import pytest

from koine.operators import selection as sel
from tests.plain_selection import run_kernel
from tests.test_kernels import LIMITS, clips_of

CANDIDATES = "bucket string, clip_id string, speaker_id string, duration_sec double, quality_score double, tokens array<string>, keys array<string>, groups map<string,string>, override_action string"
SHARES = {f"phone:{c}": (i + 1) / 55 for i, c in enumerate("abcdefghij")}


def frame(spark, clips, bucket="b"):
    return spark.createDataFrame([(bucket, c["clip_id"], c["speaker"], c["duration"], c["quality"], c["tokens"], sorted(c["keys"]), c["groups"], c["action"]) for c in clips], CANDIDATES)


def targets(spark):
    return spark.createDataFrame([("phone", t.split(":")[1], w) for t, w in SHARES.items()], "family string, token string, target double")


def value(clips, ids):
    counts = Counter(t for c in clips if c["clip_id"] in ids for t in c["tokens"])
    return math.fsum(SHARES[t] * math.log(1 + n) for t, n in counts.items())


def kept(clips, plan, limits, until):
    chosen = [c for c in clips if plan[c["clip_id"]].disposition == "selected"]
    free = [c for c in chosen if c["action"] != "force_include"]
    speakers, groups = Counter(c["speaker"] for c in free), Counter(c["groups"]["audio"] for c in free)
    assert limits.max_clips_per_speaker is None or max(speakers.values()) <= limits.max_clips_per_speaker
    if limits.max_duration_per_speaker is not None:
        assert all(sum(c["duration"] for c in free if c["speaker"] == s) <= limits.max_duration_per_speaker + 1e-9 for s in speakers)
    assert not limits.duplicates or max(groups.values()) <= limits.duplicates["audio"]
    assert limits.hard_min_quality is None or all(c["quality"] is not None and c["quality"] >= limits.hard_min_quality for c in free)
    if limits.max_low_quality_ratio is not None:
        assert sum(c["quality"] is not None and c["quality"] < limits.low_quality_below for c in free) <= limits.max_low_quality_ratio * len(free)
    assert sum(c["duration"] for c in chosen) <= 1.02 * until + 1e-9
    assert sorted(plan[c["clip_id"]].selection_rank for c in chosen) == list(range(1, len(chosen) + 1))
    return {c["clip_id"] for c in chosen}


@pytest.mark.parametrize("limits", LIMITS)
def test_utility_and_limits(spark, limits):
    clips = clips_of(5, 150)
    w = sel.Weights(local_search_steps=0, speaker_bonus=0.0, quality_bonus=0.0)
    plan = {r.clip_id: r for r in sel.select(frame(spark, clips), targets(spark), {"b": 60.0}, limits, weights=w).collect()}
    assert plan.keys() == {c["clip_id"] for c in clips}
    got = value(clips, kept(clips, plan, limits, 60.0))
    exact = run_kernel("b", clips, SHARES, {}, 60.0, limits, w)
    assert got >= 0.95 * value(clips, {r[1] for r in exact if r[2] == "selected"}) > 0


def test_forced_barred_and_required_clips_of_two_buckets(spark):
    clips = clips_of(8, 60)
    for c in clips:
        c["keys"] = {f"k{int(c['clip_id'][1:]) % 9}"}
    clips[3]["action"], clips[4]["action"], clips[5]["action"], clips[6]["action"] = "force_include", "force_exclude", "hard_reject", "return_to_reserve"
    wanted = {f"k{i}": {"required": i < 5, "effective_minimum": 4, "weight": 1.0 + i} for i in range(7)} | {"k8": {"required": True, "effective_minimum": 2}}
    limits = sel.Limits(max_clips_per_speaker=30, duplicates={"audio": 1})
    bounds = spark.createDataFrame([(f, c["required"], c["effective_minimum"], c.get("weight", 1.0)) for f, c in wanted.items()], "feature string, required boolean, effective_minimum int, weight double")
    both = frame(spark, clips).unionByName(frame(spark, clips, "other")).repartition(5)
    rows = sel.select(both, targets(spark), {"b": 90.0, "other": 1.0}, limits, bounds).collect()
    exact = run_kernel("b", [c for c in clips if c["action"] != "hard_reject"], SHARES, wanted, 90.0, limits, sel.Weights())
    needed = lambda ids: Counter(k for c in clips if c["clip_id"] in ids for k in c["keys"])
    for bucket in ("b", "other"):
        plan = {r.clip_id: r for r in rows if r.bucket == bucket}
        assert plan.keys() == {c["clip_id"] for c in clips} - {"c005"}
        first = {c for c, r in plan.items() if r.selected_reason in ("forced", "coverage")}
        assert plan["c003"].selection_rank == 1 and plan["c003"].selected_reason == "forced" and plan["c004"].reserve_reason == plan["c006"].reserve_reason == "barred by an override"
        have, want = needed(first), needed({r[1] for r in exact if r[7] in ("forced", "coverage")})
        assert all(min(have[k], c["effective_minimum"]) == min(want[k], c["effective_minimum"]) for k, c in wanted.items() if c["required"])
        assert len(first) <= 1.1 * sum(r[7] in ("forced", "coverage") for r in exact)
        assert {r.selected_reason for r in plan.values()} - {"exchange"} == ({"forced", "coverage", "utility", None} if bucket == "b" else {"forced", "coverage", None})
    chosen = [r for r in rows if r.disposition == "selected" and r.bucket == "b"]
    told = json.loads(max(chosen, key=lambda r: r.selection_rank).positive_contributions)
    assert {"score", "families", "reasons"} <= told.keys() and 0 < len(told["reasons"]) <= 5 and told["families"].keys() == {"phone"}


def test_blocked_features_are_named(spark):
    clips = [{"clip_id": f"c{i}", "speaker": "s", "duration": 1.0, "quality": None, "tokens": ["phone:a"], "keys": {"k"}, "groups": {}, "action": None} for i in range(4)]
    bounds = spark.createDataFrame([("k", True, 3)], "feature string, required boolean, effective_minimum int")
    plan = sel.select(frame(spark, clips), targets(spark), {"b": 9.0}, sel.Limits(max_clips_per_speaker=2), bounds).collect()
    assert sorted((r.clip_id, r.selected_reason, r.reserve_reason, r.penalties) for r in plan) == [("c0", "coverage", None, "{}"), ("c1", "coverage", None, "{}"), ("c2", None, "limits", '{"blocked":["k"]}'), ("c3", None, "limits", '{"blocked":["k"]}')]


def test_exchanges_add_utility(spark, monkeypatch):
    monkeypatch.setitem(sel.SHARE, "utility", 0.2)  # coarse rounds leave something to exchange
    clips = clips_of(2, 120)
    w = {n: sel.Weights(local_search_steps=n, speaker_bonus=0.0, quality_bonus=0.0, tolerance=0.1) for n in (0, 50)}
    plans = {n: sel.select(frame(spark, clips), targets(spark), {"b": 30.0}, weights=x).collect() for n, x in w.items()}
    got = {n: value(clips, {r.clip_id for r in p if r.disposition == "selected"}) for n, p in plans.items()}
    assert got[50] > got[0] and any(r.selected_reason == "exchange" for r in plans[50])
    assert abs(sum(c["duration"] for c in clips if c["clip_id"] in {r.clip_id for r in plans[50] if r.disposition == "selected"}) - 30) <= 3


def test_acoustic_diversity_in_rounds(spark):
    vectors = {"c0": [0.0, 1.0], "c1": [0.0, float("nan")], "c2": [4.0, 1.0], "c3": [float("nan"), float("nan")]}
    clips = [{"clip_id": c, "speaker": "s", "duration": 1.0, "quality": None, "tokens": ["phone:a"], "keys": set(), "groups": {}, "action": None} for c in vectors]
    df = frame(spark, clips).join(spark.createDataFrame(list(vectors.items()), "clip_id string, vector array<double>"), "clip_id")
    plan = sel.select(df, targets(spark), {"b": 2.0}, weights=sel.Weights(acoustic=1.0, local_search_steps=0)).collect()
    assert {r.clip_id for r in plan if r.disposition == "selected"} == {"c0", "c2"}


def test_repeated_ids_empty_pools_and_nulls(spark):
    clips = [{"clip_id": "c", "speaker": None, "duration": None, "quality": None, "tokens": None, "keys": [], "groups": None, "action": None}] * 2 + clips_of(1, 3)
    plan = sel.select(frame(spark, clips), targets(spark), {"b": 2.0}).collect()
    assert Counter(r.clip_id for r in plan) == {"c": 2, "c000": 1, "c001": 1, "c002": 1}
    assert sel.select(frame(spark, []), targets(spark), {"b": 2.0}).collect() == []


def test_scarce_keys_are_summed_once_and_tokens_stay_where_they_are(spark, monkeypatch):
    """The same plan whether all keys go to every task or the commonest three; no round shuffles tokens where all do."""
    clips = clips_of(7, 16)
    few = sel.Weights(local_search_steps=0)
    plans, cut, scored = [], sel.cut, []

    def told(df, name):
        if name == "scored":
            scored.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(sel, "cut", told)
    try:
        for most in (3, 1_000_000):
            monkeypatch.setattr(sel, "SENT_KEYS", most, raising=False)
            scored.clear()
            rows = sel.select(frame(spark, clips), targets(spark), {"b": 20.0}, weights=few).collect()
            plans.append(sorted((r.clip_id, r.disposition, r.selection_rank or 0, r.selected_reason or "", round(r.selection_score, 7)) for r in rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert plans[0] == plans[1] and sum(r[1] == "selected" for r in plans[0]) > 3
    assert scored and not any("hashpartitioning(key" in p for p in scored)


def test_tokens_of_candidates_are_read_once(spark):
    """Clips that hold a token are counted by the keys that the pool has, not from the texts again."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def told(tokens):
        seen.add(1)
        return tokens

    clips = clips_of(3, 8)
    rows = frame(spark, clips).withColumn("tokens", told.asNondeterministic()("tokens"))
    plan = sel.select(rows, targets(spark), {"b": 5.0}, weights=sel.Weights(local_search_steps=0)).collect()
    assert len(plan) == 8 == seen.value and any(r.disposition == "selected" for r in plan)


def test_gains_of_a_round_are_sums_over_one_array(spark):
    """Empty lists, keys without a worth and keys of later rounds that are worth nothing add nothing."""
    rows = [(0, [5, -7, 9]), (1, []), (2, [1]), (3, [9]), (4, None), (5, [-7, 2])]
    keyed = spark.createDataFrame(rows, "cid long, keys array<long>").repartition(2)
    worth = spark.createDataFrame([(9, 0.5), (-7, 0.25), (5, 1.0)], "key long, worth double")
    places = sel._Places(keyed, worth)
    assert {r.cid: r.worth for r in places.sums(worth).collect()} == {0: 1.75, 3: 0.5, 5: 0.25}
    assert {r.cid: r.worth for r in places.sums(worth.where("key > 5")).collect()} == {0: 0.5, 3: 0.5}
    assert sel._Places(keyed, worth.where("key > 9")).sums(worth.where("key > 9")).collect() == []
