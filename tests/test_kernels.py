"""Sequential choices against plain versions of themselves."""

import math
import random
from collections import Counter

import pytest

from koine.operators import coverage as cov
from koine.operators import selection as sel
from koine.operators import split as sp
from tests import plain_selection as plain


def clips_of(seed, n=40):
    rng = random.Random(seed)
    return [
        {"clip_id": f"c{i:03}", "speaker": f"s{rng.randrange(6)}", "duration": rng.choice([1.0, 2.0, 3.5]), "quality": rng.choice([None, 30.0, 60.0, 90.0]),
         "tokens": sorted({f"phone:{rng.choice('abcdefghij')}" for _ in range(rng.randint(1, 5))}), "keys": {f"k{rng.randrange(8)}" for _ in range(2)}, "groups": {"audio": f"g{rng.randrange(25)}"}, "action": None}
        for i in range(n)
    ]


LIMITS = [
    sel.Limits(),
    sel.Limits(max_clips_per_speaker=3, duplicates={"audio": 1}),
    sel.Limits(max_duration_per_speaker=6.0, hard_min_quality=40.0),
    sel.Limits(low_quality_below=50.0, max_low_quality_ratio=0.3),
]


@pytest.mark.parametrize("limits", LIMITS[:3])
@pytest.mark.parametrize("seed", range(5))
def test_lazy_greedy_is_greedy(limits, seed):
    clips, shares, w = clips_of(seed), {f"phone:{c}": (i + 1) / 55 for i, c in enumerate("abcdefghij")}, sel.Weights()
    ledger, utility = sel.Ledger(limits), sel.Utility(shares, 1.0)
    got = [i for i, _ in plain.fill(clips, ledger, utility, set(), 30.0, w)]
    ledger, utility, want, taken = sel.Ledger(limits), sel.Utility(shares, 1.0), [], set()
    while ledger.total < 0.98 * 30:
        best = None
        for i, c in enumerate(clips):
            if i in taken or not ledger.admits(c) or ledger.total + c["duration"] > 1.02 * 30:
                continue
            score = utility.gain(c["tokens"]) + w.speaker_bonus * (ledger.clips[c["speaker"]] == 0) + w.quality_bonus * (c["quality"] or 0) / 100
            if best is None or score > best[0]:
                best = (score, i)
        if best is None:
            break
        want.append(best[1])
        taken.add(best[1])
        ledger.put(clips[best[1]])
        utility.put(clips[best[1]]["tokens"])
    assert got == want


@pytest.mark.parametrize("limits", LIMITS)
def test_plan_keeps_limits_whatever_the_order(limits):
    shares = {f"phone:{c}": 0.1 for c in "abcdefghij"}
    wanted = {f"k{i}": {"required": i < 4, "effective_minimum": 2} for i in range(8)}
    clips = clips_of(3)
    clips[5]["action"], clips[6]["action"] = "force_include", "force_exclude"
    rows = plain.run_kernel("b", clips, shares, wanted, 30.0, limits, sel.Weights(local_search_steps=5))
    chosen = [c for r in rows if r[2] == "selected" for c in clips if c["clip_id"] == r[1]]
    assert len(rows) == len(clips) and "c005" in {c["clip_id"] for c in chosen} and "c006" not in {c["clip_id"] for c in chosen}
    free = [c for c in chosen if c["action"] is None]
    if limits.max_clips_per_speaker:
        assert max(Counter(c["speaker"] for c in chosen).values()) <= limits.max_clips_per_speaker
    if limits.hard_min_quality:
        assert all(c["quality"] is not None and c["quality"] >= limits.hard_min_quality for c in free)
    if limits.duplicates:
        assert max(Counter(c["groups"]["audio"] for c in chosen).values()) <= 1
    if limits is LIMITS[0]:
        have = Counter(k for c in chosen for k in c["keys"])
        assert all(have[f"k{i}"] >= 2 for i in range(4))
    assert [r[4] for r in rows if r[2] == "selected"] == list(range(1, len(chosen) + 1))
    assert sum(c["duration"] for c in chosen) <= 30 * 1.02 + 1e-9


@pytest.mark.parametrize("limits", LIMITS[:3])
@pytest.mark.parametrize("seed", range(4))
def test_lazy_reservation_is_greedy(limits, seed):
    clips, wanted = clips_of(seed), {f"k{i}": {"required": i != 3, "effective_minimum": 1 + i % 3} for i in range(8)}
    got, _, unmet = plain.reserve(clips, wanted, sel.Ledger(limits))
    ledger, short, taken = sel.Ledger(limits), {f: c["effective_minimum"] for f, c in wanted.items() if c["required"]}, []
    least, held = dict(short), Counter(f for c in clips for f in c["keys"])
    while True:
        best = None
        for i, c in enumerate(clips):
            need = [f for f in c["keys"] if short.get(f, 0) > 0]
            if i in taken or not need or not ledger.admits(c):
                continue
            s = math.fsum(short[f] / least[f] / math.sqrt(held[f] + 1) for f in need) + 0.1 * (c["quality"] or 0) / 100 + 0.05 * (ledger.clips[c["speaker"]] == 0) - 0.01 * c["duration"]
            if best is None or s > best[0] + 1e-12:
                best = (s, i)
        if best is None:
            break
        taken.append(best[1])
        ledger.put(clips[best[1]])
        for f in clips[best[1]]["keys"] & short.keys():
            short[f] -= 1
    assert got == taken and unmet == {f for f, n in short.items() if n > 0}


def test_local_search_only_gains():
    clips, shares, w = clips_of(9), {f"phone:{c}": 0.1 for c in "abcdefghij"}, sel.Weights(tolerance=0.1)
    ledger, utility = sel.Ledger(sel.Limits()), sel.Utility(shares, 1.0)
    chosen = set(range(10))
    for i in chosen:
        ledger.put(clips[i])
        utility.put(clips[i]["tokens"])
    before, total = utility.value(), ledger.total
    moves = sel.improve(clips, chosen, list(range(10, 40)), {0}, ledger, utility, total, w)
    assert moves and 0 in chosen and utility.value() > before and abs(ledger.total - total) <= 0.1 * total + 1e-9
    again = sel.Utility(shares, 1.0)
    for i in chosen:
        again.put(clips[i]["tokens"])
    assert math.isclose(again.value(), utility.value(), abs_tol=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_lazy_batches_are_greedy(seed):
    rng = random.Random(seed)
    clips = [{"clip_id": f"c{i:02}", "speaker": f"s{rng.randrange(4)}", "text": rng.choice(["", "x", "y"]), "keys": [f"f{rng.randrange(10)}" for _ in range(3)], "rate": rng.random()} for i in range(40)]
    gains = {f"f{i}": (rng.randint(1, 4), rng.random()) for i in range(8)}
    config = cov.PlannerConfig(max_per_speaker=4)
    got = cov.pick_batch(clips, gains, 12, config)
    left, speakers, texts, want, rest = {f: d for f, (d, _) in gains.items()}, Counter(), Counter(), [], list(clips)
    while len(want) < 12:
        def score(c):
            if speakers[c["speaker"]] >= 4:
                return 0.0
            s = math.fsum(gains[f][1] * left[f] / gains[f][0] for f in c["keys"] if left.get(f, 0) > 0) * c["rate"]
            return s / ((1 + 0.2 * speakers[c["speaker"]]) * (1 + texts[c["text"]] if c["text"] else 1))

        best = max(rest, key=lambda c: (score(c), [-ord(x) for x in c["clip_id"]]))
        if score(best) <= 0:
            break
        want.append(best["clip_id"])
        speakers[best["speaker"]] += 1
        texts[best["text"]] += 1
        for f in best["keys"]:
            if left.get(f, 0) > 0:
                left[f] -= 1
        rest.remove(best)
    assert [c for c, _ in got] == want


@pytest.mark.parametrize("seed", range(5))
def test_bounded_batches_stop_before_they_could_differ(seed):
    rng = random.Random(seed)
    clips = [{"clip_id": f"c{i:03}", "speaker": f"s{rng.randrange(5)}", "text": "", "keys": [f"f{rng.randrange(12)}" for _ in range(3)], "rate": rng.random()} for i in range(120)]
    gains, config = {f"f{i}": (rng.randint(1, 6), rng.random()) for i in range(10)}, cov.PlannerConfig()
    want = cov.pick_batch(clips, gains, 15, config)
    first = lambda c: math.fsum(gains[f][1] for f in c["keys"] if f in gains) * c["rate"]
    order = sorted(clips, key=lambda c: (-first(c), c["clip_id"]))
    for n in (5, 20, 60):
        got = cov.pick_batch(order[:n], gains, 15, config, first(order[n - 1]))
        assert got == want[: len(got)]
    assert cov.pick_batch(order, gains, 15, config, None) == want


@pytest.mark.parametrize("pattern", ["1v2", "2v1"])
def test_exchanges_of_pairs(pattern):
    w = sel.Weights(tolerance=0.15, exchanges=("1v1", pattern))
    shares, moved = {f"phone:{c}": 0.1 for c in "abcdefghij"}, 0
    for seed in range(6):
        clips = clips_of(seed, 24)
        results = []
        for weights in (sel.Weights(tolerance=0.15), w):
            ledger, utility, chosen = sel.Ledger(sel.Limits(max_clips_per_speaker=5)), sel.Utility(shares, 1.0), set(range(6))
            for i in chosen:
                ledger.put(clips[i])
                utility.put(clips[i]["tokens"])
            total = ledger.total
            sel.improve(clips, chosen, list(range(6, 24)), {0}, ledger, utility, total, weights)
            assert 0 in chosen and abs(ledger.total - total) <= 0.15 * total + 1e-9
            again = sel.Utility(shares, 1.0)
            for i in chosen:
                again.put(clips[i]["tokens"])
            assert math.isclose(again.value(), utility.value(), abs_tol=1e-9)
            results.append((utility.value(), len(chosen)))
        assert results[1][0] >= results[0][0] - 1e-9
        moved += results[1] != results[0]
    assert moved or pattern == "2v1"


@pytest.mark.parametrize("pattern, start", [("2v1", {0, 1}), ("1v2", {2})])
def test_an_exchange_that_only_pairs_can_make(pattern, start):
    clip = lambda name, seconds, tokens: {"clip_id": name, "speaker": "s", "duration": seconds, "quality": None, "tokens": tokens, "keys": set(), "groups": {}, "action": None}
    more = ["t:c"] if pattern == "2v1" else []
    clips = [clip("p", 1.0, ["t:a"]), clip("q", 1.0, ["t:b"] if more else ["t:b", "t:d"]), clip("z", 2.0, ["t:a", "t:b", *more])]
    for exchanges, moves in ((("1v1",), 0), (("1v1", pattern), 1)):
        ledger, utility, chosen = sel.Ledger(sel.Limits()), sel.Utility({f"t:{x}": 1.0 for x in "abcd"}, 1.0), set(start)
        for i in chosen:
            ledger.put(clips[i])
            utility.put(clips[i]["tokens"])
        assert sel.improve(clips, chosen, [i for i in range(3) if i not in start], set(), ledger, utility, 2.0, sel.Weights(exchanges=exchanges)) == moves
        assert chosen == ({0, 1, 2} - start if moves else start) and ledger.total == 2.0


def test_families_have_weights_and_temperatures():
    u = sel.Utility({"phone:a": 0.5, "biphone:a-b": 0.5, "mora:x": 1.0}, 1.0, {"biphone": 2.0, "mora": 0.0}, {"biphone": 4.0})
    assert math.isclose(u.gain(["phone:a", "biphone:a-b", "mora:x"]), 0.5 * math.log(2) + 1.0 * math.log(5 / 4))
    told = u.explained(["phone:a", "biphone:a-b", "mora:x"])
    assert told["reasons"][0][0] == "phone:a" and set(told["families"]) == {"phone", "biphone"}


def test_acoustic_diversity():
    import numpy as np

    v = np.array([[0.0, 1.0], [0.0, np.nan], [4.0, 1.0], [np.nan, np.nan]])
    d = plain.Diversity(v, 2.0)
    assert d.penalty(0) == 0
    d.put(0)
    std = np.nanstd(v[:, 0])
    assert d.penalty(0) == 2 and d.penalty(1) == 2 and d.penalty(3) == 2 and abs(d.penalty(2) - 2 / (1 + 4 / std)) < 1e-12
    clips = [{"clip_id": f"c{i}", "speaker": "s", "duration": 1.0, "quality": None, "tokens": ["phone:a"], "keys": set(), "groups": {}, "action": None} for i in range(4)]
    rows = plain.run_kernel("b", clips, {"phone:a": 1.0}, {}, 2.0, sel.Limits(), sel.Weights(acoustic=1.0, local_search_steps=0), v)
    assert [r[1] for r in rows if r[2] == "selected"] == ["c0", "c2"]


def test_batch_sizes():
    assert cov.batch_size(0, 0.5, 10) == 0 and cov.batch_size(5, 0.5, 1000) == 20 and cov.batch_size(100, 0.5, 1000) == 300 and cov.batch_size(10**6, 0.5, 10**6) == 500 and cov.batch_size(100, 0.5, 7) == 7


def test_split_by_utterances():
    assert set(sp.by_utterances({f"s{i}": 5 for i in range(20)}, {"train": 0.8, "val": 0.1, "test": 0.1}).values()) == {"train", "val", "test"}


def test_coverage_loop(spark, tmp_path):
    rows = [(f"c{i:02}", f"s{i % 3}", None, 1.0 + i % 2, None, None, [f"phoneme:{'abc'[i % 3]}"], (True, 0.5, 0.1, 0.0, 0.1), False) for i in range(60)]
    index = spark.createDataFrame(rows, "clip_id string, client_id string, normalized_text string, duration_sec double, up_votes long, down_votes long, feature_keys array<string>, cheap_quality struct<decode_ok:boolean,peak:double,rms:double,clipping_ratio:double,silence_ratio:double>, invalidated boolean")
    targets = spark.createDataFrame(cov.target_rows({"phoneme:a": 5, "phoneme:b": {"minimum": 2, "desired": 4}}), "feature string, minimum long, desired long, required boolean, weight double")
    analyze = lambda batch: batch.selectExpr("clip_id", "cast(substring(clip_id, 2) as int) % 2 = 0 as passed")
    config = cov.PlannerConfig(min_batch=4, max_batch=6)
    state = cov.run_loop(index, targets, analyze, str(tmp_path / "s.json"), config=config)
    assert state.stop == "complete" and state.iteration >= 2 and len(set(state.analyzed)) == len(state.analyzed)
    assert not any(int(c[1:]) % 3 == 2 for c in state.analyzed), "clips that help nothing aren't analysed"
    assert cov.run_loop(index, targets, analyze, str(tmp_path / "t.json"), config=config, dry_run=True).stop == "dry_run"
    never = lambda batch: batch.selectExpr("clip_id", "false as passed")
    assert cov.run_loop(index, targets, never, str(tmp_path / "u.json"), config=config).stop == "candidate_exhausted"
    assert cov.run_loop(index, targets, never, str(tmp_path / "w.json"), cov.LoopLimits(max_audio_hours=1e-4), config=config).stop == "analysis_budget_exceeded"
    assert cov.run_loop(index, targets, never, str(tmp_path / "x.json"), config=config, cancelled=lambda: True).stop == "cancelled"
    many = spark.createDataFrame(cov.target_rows({"phoneme:a": 50}), targets.schema)
    assert cov.run_loop(index, many, analyze, str(tmp_path / "y.json"), config=config).stop in ("unreachable", "candidate_exhausted")

    def broken(batch):
        raise OSError("no disk")

    with pytest.raises(OSError):
        cov.run_loop(index, targets, broken, str(tmp_path / "z.json"), config=config)
    assert '"stop": "failed"' in (tmp_path / "z.json").read_text()
    assert cov.run_loop(index, targets, never, str(tmp_path / "v.json"), cov.LoopLimits(max_iterations=1), config=config).stop == "iteration_limit_reached"
