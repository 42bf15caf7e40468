"""Plain greedy selection of one bucket, clip by clip: what the rounds of koine.operators.selection are held against."""

from __future__ import annotations

import heapq
import json
import math
import warnings
from collections import Counter

import numpy as np

from koine.operators.selection import Ledger, Limits, Utility, Weights, improve


def reserve(clips: list[dict], constraints: dict[str, dict], ledger: Ledger) -> tuple[list[int], set[str], set[str]]:
    """Indices of clips taken for required features until each has its effective minimum; features blocked by limits,
    and features left short. Highest gain first, ties by clip_id; gains only fall, so stale ones are bounds."""
    least = {f: c["effective_minimum"] for f, c in constraints.items() if c["required"] and c["effective_minimum"] > 0}
    short, held = dict(least), Counter(f for c in clips for f in c["keys"] & least.keys())
    worth = {f: constraints[f].get("weight", 1.0) / math.sqrt(held[f] + 1) / n for f, n in least.items()}

    def score(i: int) -> float | None:
        c = clips[i]
        needed = [f for f in c["keys"] if short.get(f, 0) > 0]
        if not needed:
            return None
        extra = 0.1 * (c["quality"] or 0.0) / 100 + 0.05 * (ledger.clips[c["speaker"]] == 0) - 0.01 * c["duration"]
        return math.fsum(worth[f] * short[f] for f in needed) + extra

    heap = [(-s, c["clip_id"], i) for i, c in enumerate(clips) if (s := score(i)) is not None]
    heapq.heapify(heap)
    chosen: list[int] = []
    waiting: list[tuple[str, int]] = []
    while heap:
        _, name, i = heapq.heappop(heap)
        if (fresh := score(i)) is None:
            continue
        if not ledger.admits(clips[i]):
            if ledger._is_low(clips[i]):  # the ratio may admit it later
                waiting.append((name, i))
            continue
        if heap and (-fresh, name) > heap[0][:2]:
            heapq.heappush(heap, (-fresh, name, i))
            continue
        chosen.append(i)
        ledger.put(clips[i])
        for f in clips[i]["keys"] & short.keys():
            short[f] -= 1
        if waiting and ledger.admits(clips[waiting[0][1]]):
            for n, j in waiting:
                if (s := score(j)) is not None:
                    heapq.heappush(heap, (-s, n, j))
            waiting = []
    unmet = {f for f, n in short.items() if n > 0}
    return chosen, {f for f in unmet if held[f] >= least[f]}, unmet


class Diversity:
    """Distance of each clip to the nearest chosen one, over standardised acoustic vectors; NaN where a number is missing.

    Two clips without a common number are at distance 0. Nothing is penalised before the first choice.
    """

    def __init__(self, vectors: np.ndarray | None, weight: float):
        self.weight = weight if vectors is not None and vectors.size else 0.0
        if self.weight:
            with np.errstate(invalid="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # a column without numbers has neither mean nor deviation
                mean, std = np.nanmean(vectors, axis=0), np.nanstd(vectors, axis=0)
            self.z = (vectors - mean) / np.where(np.nan_to_num(std) < 1e-12, 1.0, std)
            self.nearest = np.full(len(vectors), np.inf)

    def put(self, i: int) -> None:
        if self.weight:
            self.nearest = np.minimum(self.nearest, np.sqrt(np.nansum((self.z - self.z[i]) ** 2, axis=1)))

    def penalty(self, i: int) -> float:
        return self.weight / (1 + self.nearest[i]) if self.weight and np.isfinite(self.nearest[i]) else 0.0


def fill(clips: list[dict], ledger: Ledger, utility: Utility, taken: set[int], until: float, weights: Weights, diversity: Diversity | None = None) -> list[tuple[int, float]]:
    """Greedy filling with stale bounds: a clip's gain only falls as others are taken, so the one whose fresh score is
    still on top is the best. The new-speaker bonus only falls, and the penalty for being near only grows. Ends at (1 - tolerance) * until; never passes
    (1 + tolerance) * until."""

    def score(i: int) -> float:
        c = clips[i]
        bonus = weights.speaker_bonus * (ledger.clips[c["speaker"]] == 0) + weights.quality_bonus * (c["quality"] or 0.0) / 100
        return utility.gain(c["tokens"]) + bonus - (diversity.penalty(i) if diversity else 0.0)

    heap = [(-score(i), clips[i]["clip_id"], i) for i in range(len(clips)) if i not in taken]
    heapq.heapify(heap)
    out, waiting = [], []
    while heap and ledger.total < (1 - weights.tolerance) * until:
        _, name, i = heapq.heappop(heap)
        c = clips[i]
        if ledger.total + c["duration"] > (1 + weights.tolerance) * until:
            continue
        if not ledger.admits(c):
            if ledger._is_low(c):  # the ratio may admit it later
                waiting.append((name, i))
            continue
        fresh = score(i)
        if heap and (-fresh, name) > heap[0][:2]:
            heapq.heappush(heap, (-fresh, name, i))
            continue
        out.append((i, fresh))
        taken.add(i)
        ledger.put(c)
        utility.put(c["tokens"])
        if diversity:
            diversity.put(i)
        if waiting and ledger.admits(clips[waiting[0][1]]):
            for n, j in waiting:
                heapq.heappush(heap, (-score(j), n, j))
            waiting = []
    return out


def run_kernel(bucket: str, clips: list[dict], shares: dict[str, float], wanted: dict[str, dict], until: float, limits: Limits, weights: Weights, vectors: np.ndarray | None = None) -> list[tuple]:
    """Forced clips, reservation, filling, local search; then the reserve by score."""
    ledger, utility, diversity = Ledger(limits), Utility(shares, weights.temperature, weights.families, weights.taus), Diversity(vectors, weights.acoustic)
    barred = {i for i, c in enumerate(clips) if c["action"] in ("force_exclude", "return_to_reserve")}
    order: list[tuple[int, float, str]] = []
    for i, c in enumerate(clips):
        if c["action"] == "force_include":
            order.append((i, utility.gain(c["tokens"]), "forced"))
            ledger.put(c)
            utility.put(c["tokens"])
    taken = {i for i, _, _ in order}
    open_ = [c if i not in barred and i not in taken else c | {"keys": set()} for i, c in enumerate(clips)]
    counts = Counter(f for i in taken for f in clips[i]["keys"])
    left = {f: c | {"effective_minimum": c["effective_minimum"] - counts[f]} for f, c in wanted.items()}
    reserved, blocked, _ = reserve(open_, left, ledger)
    for i in reserved:
        order.append((i, utility.gain(clips[i]["tokens"]), "coverage"))
        utility.put(clips[i]["tokens"])
    taken |= set(reserved)
    for i in taken:
        diversity.put(i)
    fixed = set(taken)
    order += [(i, s, "utility") for i, s in fill(clips, ledger, utility, taken | barred, until, weights, diversity)]
    chosen = {i for i, _, _ in order}
    outside = [i for i in range(len(clips)) if i not in chosen and i not in barred]
    improve(clips, chosen, outside, fixed, ledger, utility, until, weights)
    order = [x for x in order if x[0] in chosen] + [(i, utility.gain(clips[i]["tokens"]), "exchange") for i in sorted(chosen - {x[0] for x in order})]
    rows, told, speakers = [], Utility(shares, weights.temperature, weights.families, weights.taus), set()
    for n, (i, s, why) in enumerate(order, 1):
        c = clips[i]
        parts = {"score": s} | told.explained(c["tokens"])
        if weights.speaker_bonus and c["speaker"] not in speakers:
            parts["speaker_diversity"] = weights.speaker_bonus
        if weights.quality_bonus and c["quality"] is not None:
            parts["quality"] = weights.quality_bonus * c["quality"] / 100
        told.put(c["tokens"])
        speakers.add(c["speaker"])
        rows.append((bucket, c["clip_id"], "selected", s, n, json.dumps(parts, ensure_ascii=False), json.dumps({}), why, None))
    rest = sorted(((-utility.gain(c["tokens"]), c["clip_id"], i) for i, c in enumerate(clips) if i not in chosen))
    for s, name, i in rest:
        reason = "barred by an override" if i in barred else "not needed" if ledger.admits(clips[i]) else "limits"
        held_up = sorted(blocked & clips[i]["keys"])
        rows.append((bucket, name, "reserve", -s, None, json.dumps({}), json.dumps({"blocked": held_up} if held_up else {}), None, reason))
    return rows
