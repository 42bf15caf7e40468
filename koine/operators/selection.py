"""Choosing clips: coverage targets, reservation, greedy filling up to a duration, local search, audit.

The choice is greedy in rounds: tables hold how often each token was taken, a round's clips are valued and accepted by
queries. The local search exchanges clips within working sets of bounded size.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import asdict, dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koine.functions.scoring import marginal, redundancy, vector_distance
from koine.scratch import appended, cut, placed, ship, summed_before


@dataclass(frozen=True)
class Limits:
    """What a selection must keep to; None leaves a bound out."""

    max_clips_per_speaker: int | None = None
    max_duration_per_speaker: float | None = None
    hard_min_quality: float | None = None
    low_quality_below: float | None = None
    max_low_quality_ratio: float | None = None
    duplicates: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Weights:
    speaker_bonus: float = 0.05
    quality_bonus: float = 0.1
    temperature: float = 1.0
    tolerance: float = 0.02
    local_search_steps: int = 200
    acoustic: float = 0.0
    exchanges: tuple[str, ...] = ("1v1",)
    families: dict[str, float] = field(default_factory=dict)
    taus: dict[str, float] = field(default_factory=dict)


def coverage_constraints(targets: DataFrame, keys: DataFrame, index_counts: DataFrame | None = None) -> DataFrame:
    """targets(feature, minimum, desired, required) with eligible clips and speakers and effective bounds.

    keys: clip_id, speaker_id, feature of eligible clips; index_counts: feature, count.
    """
    have = keys.groupBy("feature").agg(F.countDistinct("clip_id").alias("eligible"), F.countDistinct("speaker_id").alias("eligible_speakers"))
    out = targets.join(have, "feature", "left").na.fill(0, ["eligible", "eligible_speakers"])
    if index_counts is not None:
        out = out.join(index_counts.select("feature", F.col("count").alias("index_count")), "feature", "left").na.fill(0, ["index_count"])
    else:
        out = out.withColumn("index_count", F.lit(None).cast("long"))
    return effective_bounds(out)


def effective_bounds(rows: DataFrame) -> DataFrame:
    """rows(minimum, desired, eligible, ...) with the bounds that the eligible clips leave."""
    desired = F.greatest("desired", "minimum")
    return rows.withColumns({"effective_minimum": F.least("minimum", "eligible"), "effective_desired": F.least(desired, F.col("eligible"))})


def first_scores(rows: DataFrame, targets: DataFrame, temperature: float = 1.0, distinct: bool = False) -> DataFrame:
    """clip_id, score of each clip before anything is chosen: its distinct tokens' target shares, weighted.

    rows: clip_id, family, token; distinct: a clip has each token once, which then needs no shuffle; targets: family, token,
    target.
    """
    own = rows.select("clip_id", "family", "token")
    own = own if distinct else own.distinct()
    gain = F.col("target") * marginal(F.lit(0.0), 1.0, temperature)
    scored = own.join(targets.select("family", "token", "target"), ["family", "token"]).groupBy("clip_id").agg(F.sum(gain).alias("score"))
    return scored


class Ledger:
    """Counters of a selection in progress."""

    def __init__(self, limits: Limits):
        self.limits, self.clips, self.seconds = limits, Counter(), Counter()
        self.groups: Counter = Counter()
        self.n = self.low = 0
        self.total = 0.0

    def _is_low(self, c: dict) -> bool:
        bound, q = self.limits.low_quality_below, c["quality"]
        return bound is not None and q is not None and q < bound

    def admits(self, c: dict) -> bool:
        lim, s = self.limits, c["speaker"]
        if lim.hard_min_quality is not None and (c["quality"] is None or c["quality"] < lim.hard_min_quality):
            return False
        if lim.max_clips_per_speaker is not None and self.clips[s] + 1 > lim.max_clips_per_speaker:
            return False
        if lim.max_duration_per_speaker is not None and self.seconds[s] + c["duration"] > lim.max_duration_per_speaker + 1e-9:
            return False
        if any(self.groups[k, c["groups"][k]] >= most for k, most in lim.duplicates.items() if c["groups"].get(k)):
            return False
        if lim.max_low_quality_ratio is not None and self._is_low(c):
            return (self.low + 1) / (self.n + 1) <= lim.max_low_quality_ratio
        return True

    def put(self, c: dict, by: int = 1) -> None:
        self.clips[c["speaker"]] += by
        self.seconds[c["speaker"]] += by * c["duration"]
        for k, g in c["groups"].items():
            if g:
                self.groups[k, g] += by
        self.n += by
        self.low += by * self._is_low(c)
        self.total += by * c["duration"]


class Utility:
    """Diminishing utility of tokens, with each clip's distinct ones. A family (what stands before a token's colon) may
    have a weight of its own and a temperature of its own; a weight of 0 leaves it out."""

    def __init__(self, targets: dict[str, float], temperature: float, weights: dict[str, float] | None = None, taus: dict[str, float] | None = None):
        family = lambda x: x.split(":", 1)[0]
        weighted = {x: w * (weights or {}).get(family(x), 1.0) for x, w in targets.items()}
        self.targets, self.counts = {x: w for x, w in weighted.items() if w > 0}, Counter()
        usual = temperature if temperature > 0 else 1.0
        own = {f: t if t > 0 else 1.0 for f, t in (taus or {}).items()}
        self.t = {x: own.get(family(x), usual) for x in self.targets}

    def worth(self, x: str) -> float:
        """What one more of a token adds."""
        n = self.t[x] + self.counts[x]
        return self.targets[x] * math.log((n + 1) / n)

    def gain(self, tokens) -> float:
        return math.fsum(self.worth(x) for x in tokens if x in self.targets)

    def gains(self) -> dict[str, float]:
        return {x: self.worth(x) for x in self.targets}

    def explained(self, tokens, most: int = 5) -> dict:
        """The gain of a clip's tokens by family, and the `most` tokens that add most."""
        parts = sorted(((self.worth(x), x) for x in tokens if x in self.targets), key=lambda p: (-p[0], p[1]))
        families: dict[str, float] = {}
        for w, x in parts:
            families[x.split(":", 1)[0]] = families.get(x.split(":", 1)[0], 0.0) + w
        return {"families": families, "reasons": [[x, w] for w, x in parts[:most]]}

    def put(self, tokens, by: int = 1) -> None:
        for x in tokens:
            self.counts[x] += by

    def given_up(self, tokens) -> tuple[float, dict[str, float]]:
        """What taking a clip away costs, and by token how much more the next one with it would then add."""
        lost, back = 0.0, {}
        for x in tokens:
            if x in self.targets:
                n, w = self.t[x] + self.counts[x], self.targets[x]
                now, less = w * math.log((n + 1) / n), w * math.log(n / (n - 1))
                lost += less
                back[x] = less - now
        return lost, back

    def value(self) -> float:
        return math.fsum(self.targets[x] * math.log(1 + n / self.t[x]) for x, n in self.counts.items() if x in self.targets and n > 0)


def improve(clips: list[dict], chosen: set[int], pool: list[int], fixed: set[int], ledger: Ledger, utility: Utility, until: float, weights: Weights) -> int:
    """Exchange chosen clips for ones outside while that adds utility and keeps every limit, the duration and what was
    reserved: one for one, and where that adds nothing one for two or two for one if `exchanges` names them. pool is all
    that may come in. A step budget, not a clock: results repeat. Returns the number of exchanges."""
    table, moves = _Tokens(clips, sorted(chosen | set(pool)), utility), 0
    for _ in range(weights.local_search_steps if chosen - fixed else 0):
        free = sorted(chosen - fixed, key=lambda i: clips[i]["clip_id"])
        outside = sorted((j for j in pool if j not in chosen), key=lambda j: clips[j]["clip_id"])
        best = table.exchange(free, outside, ledger, until, weights.tolerance) if "1v1" in weights.exchanges else None
        if best is None and {"1v2", "2v1"} & set(weights.exchanges):
            gain_of = utility.gains()
            gains = sorted(((math.fsum(gain_of[x] for x in clips[j]["tokens"] if x in gain_of), j) for j in outside), key=lambda x: (-x[0], clips[x[1]]["clip_id"]))
            for pattern in ("1v2", "2v1"):
                if best is None and pattern in weights.exchanges:
                    best = _best_exchange(clips, pattern, free, gains, ledger, utility, until, weights)
        if best is None:
            break
        for gone, by in ((best[0], -1), (best[1], 1)):
            for k in gone:
                utility.put(clips[k]["tokens"], by)
                ledger.put(clips[k], by)
                table.put(k, by)
        chosen -= set(best[0])
        chosen |= set(best[1])
        moves += 1
    return moves


class _Tokens:
    """Tokens of a working set's clips as numbers, with what each is worth now: gains of all clips are sums over one array."""

    def __init__(self, clips: list[dict], places: list[int], utility: Utility):
        self.clips = clips
        names = sorted({x for i in places for x in clips[i]["tokens"] if x in utility.targets})
        at = {x: k for k, x in enumerate(names)}
        self.own = {i: np.array([at[x] for x in clips[i]["tokens"] if x in at], dtype=np.int64) for i in places}
        self.weight, self.t, self.counts = (np.array([f(x) for x in names], dtype=np.float64) for f in (utility.targets.get, utility.t.get, lambda x: utility.counts[x]))

    def put(self, i: int, by: int) -> None:
        self.counts[self.own[i]] += by

    def exchange(self, free: list[int], outside: list[int], ledger: Ledger, until: float, tolerance: float):
        """The exchange of one clip for one that adds most, as ((out,), (in,)), or None."""
        if not free or not outside:
            return None
        n = self.t + self.counts
        more = self.weight * np.log((n + 1) / n)
        less = np.where(self.counts > 0, self.weight * np.log(n / np.maximum(n - 1, 1e-300)), 0.0)
        end = len(self.weight)  # a place worth nothing: no clip's list is empty
        flat = np.concatenate([np.append(self.own[j], end) for j in outside])
        starts = np.concatenate([[0], np.cumsum([len(self.own[j]) + 1 for j in outside])[:-1]])
        gains = np.add.reduceat(np.append(more, 0.0)[flat], starts)
        best, rank, back = None, 1e-9, np.zeros(end + 1)
        for i in free:
            own = self.own[i]
            lost, shared = less[own].sum(), less[own] - more[own]
            if gains.max() + shared.sum() - lost <= rank:
                continue
            back[own] = shared
            total = gains - lost + np.add.reduceat(back[flat], starts)
            back[own] = 0.0
            ledger.put(self.clips[i], -1)
            for k in np.argsort(-total, kind="stable"):
                if total[k] <= rank:
                    break
                b = self.clips[outside[k]]
                if abs(ledger.total + b["duration"] - until) <= tolerance * until and ledger.admits(b):
                    best, rank = ((i,), (outside[k],)), total[k]
                    break
            ledger.put(self.clips[i])
        return best


def _best_exchange(clips, pattern: str, free: list[int], gains: list[tuple[float, int]], ledger: Ledger, utility: Utility, until: float, weights: Weights):
    """The exchange of a pattern with pairs that adds most, as (out, in), or None. gains: (gain, clip) falling; what goes out gives
    back at most its slack, so the search ends where no later clip can do better."""
    best, rank = None, 1e-9
    for out in [(i,) for i in free] if pattern[0] == "1" else combinations(free, 2):
        lost, slack = 0.0, 0.0
        for i in out:
            less, back = utility.given_up(clips[i]["tokens"])
            lost, slack = lost + less, slack + sum(back.values())
            utility.put(clips[i]["tokens"], -1)
            ledger.put(clips[i], -1)
        for n, (gain, j) in enumerate(gains):
            if (1 + (pattern[2] == "2")) * gain + slack - lost <= rank:
                break
            first, seconds = utility.gain(clips[j]["tokens"]), gains[n + 1 :] if pattern[2] == "2" else [(0.0, None)]
            if not ledger.admits(clips[j]):
                continue
            utility.put(clips[j]["tokens"])
            ledger.put(clips[j])
            for more, k in seconds:
                if gain + more + slack - lost <= rank:
                    break
                total = first - lost + (utility.gain(clips[k]["tokens"]) if k is not None else 0.0)
                length = ledger.total + (clips[k]["duration"] if k is not None else 0.0)
                if total > rank and abs(length - until) <= weights.tolerance * until and (k is None or ledger.admits(clips[k])):
                    best, rank = (out, (j,) if k is None else (j, k)), total
            utility.put(clips[j]["tokens"], -1)
            ledger.put(clips[j], -1)
        for i in out:
            utility.put(clips[i]["tokens"])
            ledger.put(clips[i])
    return best


PLAN_FIELDS = "bucket string, clip_id string, disposition string, selection_score double, selection_rank long, positive_contributions string, penalties string, selected_reason string, reserve_reason string"
#: Clips of a round score at least this share of the best, by phase; a round looks at FIRST of them and as many as were taken before.
SHARE, FIRST = {"coverage": 0.75, "utility": 0.5}, 32
#: Working sets of the local search: chosen clips that cost least to give up, clips outside that would add most.
FREE, OUTSIDE = 200, 1000
#: Keys of a vocabulary, the commonest ones, whose worth every task has; rows up to which what was taken, or what a round looks
#: at, goes to every task too.
SENT_KEYS, SENT_ROWS = 1_000_000, 200_000
#: Decimals of scores, so that the order of a sum's parts doesn't decide ties.
DIGITS = 9


def _key(*parts) -> Column:
    """What is counted (a token, a speaker, a group, a bucket), as a 64-bit hash within a bucket."""
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _by_family(of: dict[str, float], usual: float, token: Column) -> Column:
    out = F.lit(float(usual))
    for family, x in sorted(of.items()):
        out = F.when(F.substring_index(token, ":", 1) == family, float(x)).otherwise(out)
    return out


def _usable(candidates: DataFrame) -> DataFrame:
    return candidates.where("coalesce(override_action, '') <> 'hard_reject'")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows at most, to every task if they are few."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _commonest(state: DataFrame) -> int:
    """How many clips hold a key at most for it not to be among the SENT_KEYS commonest of state(key, held); 0 if all are."""
    left = SENT_KEYS
    for r in state.groupBy("held").agg(F.count("*").alias("n")).orderBy(F.desc("held")).toLocalIterator():  # a row a count
        left -= r.n
        if left < 0:
            return r.held
    return 0


class _Places:
    """Clips' keys as places in the sorted list of the keys that every task knows: a round's gains are sums over one array of
    what each key is worth, and nothing is hashed again. worth: key, worth of the first round; later ones have no other keys."""

    def __init__(self, keyed: DataFrame, worth: DataFrame):
        self.known = np.sort(worth.select("key").toArrow()["key"].to_numpy())  # SENT_KEYS at most
        sent = keyed.sparkSession.sparkContext.broadcast(self.known)

        def found(batches):
            known = sent.value
            for b in batches:
                lists = b.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, flat)
                hit = known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
                ends = np.append(0, np.cumsum(hit))[np.append(0, np.cumsum(sizes))]
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit], pa.int32()))], names=["cid", "places"])

        self.rows = cut(keyed.select("cid", "keys").mapInArrow(found, "cid long, places array<int>"), "places")

    def sums(self, worth: DataFrame) -> DataFrame:
        """cid, worth of all of a clip's keys that are known, where that is more than nothing."""
        told = worth.toArrow()
        values = np.zeros(len(self.known) + 1)
        values[np.searchsorted(self.known, told["key"].to_numpy())] = told["worth"].to_numpy()
        sent = self.rows.sparkSession.sparkContext.broadcast(values)

        def summed(batches):
            for b in batches:
                lists, end = b.column(1), len(sent.value) - 1
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))[:-1]
                gains = np.add.reduceat(sent.value[np.append(flat, end)], starts) if len(starts) else np.zeros(0)
                more = (sizes > 0) & (gains > 0)  # reduceat gives an empty list the next one's first
                yield pa.record_batch([b.column(0).filter(pa.array(more)), pa.array(gains[more])], names=["cid", "worth"])

        return self.rows.mapInArrow(summed, "cid long, worth double")


def _met(keyed: DataFrame, table: DataFrame, line: int) -> DataFrame:
    """cid, columns of table(key, held, ...) for each key of the clips. Those held by more than `line` go to every task, so that no
    token of a clip is shuffled for them; what is left without them meets the others by a shuffle."""
    rows, common = keyed.select("cid", F.explode("keys").alias("key")), F.broadcast(table.where(F.col("held") > line))
    met = rows.join(common, "key")
    if not line:
        return met
    return met.unionByName(rows.join(F.broadcast(table.where(F.col("held") > line).select("key")), "key", "left_anti").join(table.where(F.col("held") <= line), "key"))


def _pool(candidates: DataFrame, limits: Limits, acoustic: bool) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of all candidates with a number `cid` each, their features, and the keys of their tokens and features."""
    keys = lambda kind, column: F.array_distinct(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: _key(kind, F.col("bucket"), t)))
    kinds = sorted(limits.duplicates)
    groups = [F.when(F.col("groups")[k] != "", _key("group", F.col("bucket"), k, F.col("groups")[k])).alias(f"g{i}") for i, k in enumerate(kinds)]
    duration, quality = F.coalesce("duration_sec", F.lit(0.0)).cast("double"), F.col("quality_score").cast("double")
    low = F.coalesce(quality < limits.low_quality_below, F.lit(False)) if limits.low_quality_below is not None else F.lit(False)
    unfit = F.coalesce(quality < limits.hard_min_quality, F.lit(True)) if limits.hard_min_quality is not None else F.lit(False)
    vector = [F.col("vector").cast("array<double>").alias("vector")] if acoustic else []
    pool = _usable(candidates).select(
        F.monotonically_increasing_id().alias("cid"), "bucket", "clip_id", _key("speaker", F.col("bucket"), F.coalesce("speaker_id", F.lit(""))).alias("speaker"), duration.alias("seconds"), F.coalesce(quality, F.lit(0.0)).alias("quality"),
        F.isnotnull("quality_score").alias("judged"), low.alias("low"), unfit.alias("unfit"), F.coalesce("override_action", F.lit("")).alias("action"), *groups, F.concat(keys("tokens", "tokens"), keys("features", "keys")).alias("keys"), F.array_distinct("keys").alias("features"), *vector,
    )
    return cut(pool, "pool"), kinds


class _Rounds:
    """A selection in rounds. State is in tables: what was taken, and how often each token, feature and group was."""

    def __init__(self, pool: DataFrame, kinds: list[str], until: dict[str, float], limits: Limits, weights: Weights):
        self.pool, self.kinds, self.until, self.limits, self.weights = pool, kinds, until, limits, weights
        self.rows = pool.drop("keys", "features")
        self.taken: DataFrame | None = None
        self.near: DataFrame | None = None
        self.keyed = pool.select("cid", "keys")
        self.steps, self.known = 0, {}

    def totals(self) -> dict[str, tuple[int, int, float]]:
        """Clips, low ones among them and seconds taken, by bucket; buckets are few."""
        return self.known

    def have(self, *columns: str) -> DataFrame:
        """What was taken, for a join."""
        return _sent(self.taken.select(*columns), sum(n for n, _, _ in self.known.values()))

    def take(self, rows: DataFrame, why: str, most: int) -> bool:
        """Add rows, as self.rows with a score, in the order of their scores, `most` at most; whether there were any. What is
        taken is a folder that grows by a round's rows."""
        new = rows.select(*self.rows.columns, "score", F.lit(why).alias("why"), F.lit(self.steps).alias("step"))
        new = self.keyed.join(_sent(new, most), "cid").select(*new.columns, "keys")
        self.taken, self.steps = appended(new, self.taken, "taken"), self.steps + 1
        before = self.known
        told = self.taken.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.sum("seconds").alias("s"))
        self.known = {r.bucket: (r.n, r.low, r.s) for r in told.collect()}
        if self.known == before:
            return False
        if self.weights.acoustic:
            self._approach(self.taken.where(F.col("step") == self.steps - 1))
        return True

    def _taken_keys(self) -> DataFrame:
        """key, n: how often each token and feature was taken."""
        return self.taken.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))

    def _approach(self, new: DataFrame) -> None:
        """Each clip's distance to the nearest taken one, over standardised vectors."""
        z = self.standard
        distance = vector_distance(F.col("z"), F.col("other"))
        found = z.join(new.select("cid", "bucket").join(z.select("cid", F.col("z").alias("other")), "cid").drop("cid"), "bucket").groupBy("cid").agg(F.min(distance).alias("nearest"))
        if self.near is not None:
            found = self.near.unionByName(found).groupBy("cid").agg(F.min("nearest").alias("nearest"))
        self.near = cut(found, "near")

    @cached_property
    def standard(self) -> DataFrame:
        """cid, bucket, z: acoustic vectors with each dimension's mean and deviation over its bucket's numbers taken out."""
        x = F.when(~F.isnan("x"), F.col("x"))
        dims = self.pool.select("cid", "bucket", F.posexplode("vector").alias("dim", "x")).withColumn("x", x)
        stats = dims.groupBy("bucket", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
        std = F.when(F.coalesce("std", F.lit(0.0)) < 1e-12, 1.0).otherwise(F.col("std"))
        stats = stats.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("dim", F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std")))).alias("stats"))
        scaled = F.zip_with("vector", "stats", lambda x, s: (x - s["mean"]) / s["std"])
        return cut(self.pool.select("cid", "bucket", "vector").join(stats, "bucket").select("cid", "bucket", scaled.alias("z")), "standard")

    def _counts(self, column: str) -> DataFrame:
        """key, n: how often the keys of what was taken were; at most as many rows as that."""
        return _sent(self.taken.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"), F.sum("seconds").alias("s")), sum(n for n, _, _ in self.known.values()))

    def open(self, timed: bool) -> DataFrame:
        """Clips that may be taken next: not barred, not taken, within every limit that holds now."""
        lim, totals = self.limits, self.totals()
        rows = self.rows.where(~F.col("unfit") & ~F.col("action").isin("force_exclude", "return_to_reserve"))
        now = lambda i: F.coalesce(*[F.when(F.col("bucket") == b, F.lit(t[i])) for b, t in totals.items()], F.lit(0)) if totals else F.lit(0)
        if timed:
            left = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(float(u))) for b, u in self.until.items()], F.lit(0.0))
            t = self.weights.tolerance
            rows = rows.where((now(2) < (1 - t) * left) & (now(2) + F.col("seconds") <= (1 + t) * left))
        if lim.max_low_quality_ratio is not None:
            rows = rows.where(~F.col("low") | ((now(1) + 1) / (now(0) + 1) <= lim.max_low_quality_ratio))
        rows = rows.withColumns({"n0": now(0), "low0": now(1), "s0": now(2).cast("double")})
        if self.taken is None:
            return rows.withColumns({"clips": F.lit(0).cast("long"), "spoken": F.lit(0.0)})
        rows = rows.join(self.have("cid"), "cid", "left_anti")
        speakers = self._counts("speaker").select(F.col("key").alias("speaker"), F.col("n").alias("clips"), F.col("s").alias("spoken"))
        rows = rows.join(speakers, "speaker", "left").na.fill({"clips": 0, "spoken": 0.0})
        if lim.max_clips_per_speaker is not None:
            rows = rows.where(F.col("clips") < lim.max_clips_per_speaker)
        if lim.max_duration_per_speaker is not None:
            rows = rows.where(F.col("spoken") + F.col("seconds") <= lim.max_duration_per_speaker + 1e-9)
        for i, kind in enumerate(self.kinds):
            full = self._counts(f"g{i}").where(F.col("key").isNotNull() & (F.col("n") >= lim.duplicates[kind]))
            rows = rows.join(full.select(F.col("key").alias(f"g{i}")), f"g{i}", "left_anti")
        return rows

    def phase(self, why: str, column: str, state: DataFrame, value, extra, timed: bool) -> None:
        """Rounds until nothing is left to take. column: of the pool, what state(name, bucket-wise key, w, a, held) values;
        value(w, a, n): what one more adds; extra(rows, first): of a clip, with `first` where its speaker is new.

        The worth of the SENT_KEYS commonest keys goes to every task of a round, which sums it by clip before anything is
        shuffled. The scarce keys of a clip are summed once, before the first round; a round adds what changed for those that
        were taken since.
        """
        lim, tol, share = self.limits, self.weights.tolerance, SHARE[why]
        keyed = self.keyed
        if column != "tokens":  # few features are required: only clips that have one
            held = _met(keyed, state.select("key", "held"), _commonest(state))
            keyed = cut(held.groupBy("cid").agg(F.collect_list("key").alias("keys")), "keyed")
        state = cut(state.select("key", "w", "a", "held"), "state")
        line, first_step, scarce, base, places = _commonest(state), self.steps, None, None, None
        value_at = lambda n: value(F.col("w"), F.col("a"), n)
        while True:
            counts = state.withColumn("n", F.lit(0).cast("long")) if self.taken is None else state.join(self._taken_keys(), "key", "left").na.fill({"n": 0})
            counts = cut(counts, "counts")
            worth = counts.where(F.col("held") > line).select("key", value_at(F.col("n")).alias("worth")).where("worth > 0")
            if column == "tokens":
                if places is None:
                    places = _Places(keyed, worth)
                parts = places.sums(worth)
            else:
                parts = keyed.select("cid", F.explode("keys").alias("key")).join(F.broadcast(worth), "key").select("cid", "worth")
            if line:
                if scarce is None:
                    common = F.broadcast(state.where(F.col("held") > line).select("key"))
                    other = keyed.select("cid", F.explode("keys").alias("key")).join(common, "key", "left_anti")
                    scarce = cut(other.join(counts.where(F.col("held") <= line), "key").select("cid", "key", "w", "a", "n"), "scarce")
                    base = cut(scarce.groupBy("cid").agg(F.sum(value_at(F.col("n"))).alias("worth")), "base")
                parts = parts.unionByName(base)
                if self.steps > first_step:
                    more = self.taken.where(F.col("step") >= first_step).select("cid")
                    changed = scarce.join(_sent(more, sum(n for n, _, _ in self.known.values())), "cid", "left_semi").groupBy("key", "w", "a", "n").agg(F.count("*").alias("k"))
                    changed = changed.select("key", (value_at(F.col("n") + F.col("k")) - value_at(F.col("n"))).alias("worth"))
                    parts = parts.unionByName(scarce.select("cid", "key").join(changed, "key").select("cid", "worth"))
            gains = parts.groupBy("cid").agg(F.sum("worth").alias("gain"))
            rows = self.open(timed).join(gains, "cid", "left" if timed else "inner").na.fill({"gain": 0.0})
            if self.near is not None:
                rows = rows.join(self.near, "cid", "left")
            penalty = redundancy(F.col("nearest"), self.weights.acoustic) if self.near is not None else F.lit(0.0)
            rows = rows.withColumn("penalty", penalty).withColumn("score", F.round(F.col("gain") + extra(F.col("clips") == 0) - F.col("penalty"), DIGITS))
            scored = cut(rows, "scored")
            bins = F.when(F.col("score") > 1e-9, F.floor(F.log2("score") * 16)).otherwise(-(1 << 20))
            found = scored.groupBy("bucket", bins.alias("bin")).agg(F.count("*").alias("k"), F.max("score").alias("top"), F.min("score").alias("low"), F.max("n0").alias("n0")).collect()  # a few hundred rows a bucket
            if not found:
                return
            lines, looked = {}, 0
            for b in {r.bucket for r in found}:
                own = sorted((r for r in found if r.bucket == b), key=lambda r: -r.bin)
                top, seen = own[0].top, 0
                for r in own:
                    seen += r.k
                    lines[b] = (r.low, share * top if top > 0 else float("-inf"))
                    if seen >= FIRST + r.n0 or r.low < share * top:
                        break
                looked += seen
            limit = lambda i: F.coalesce(*[F.when(F.col("bucket") == b, F.lit(float(x[i]))) for b, x in lines.items()])
            near = scored.where((F.col("score") >= limit(0)) & (F.col("score") >= limit(1)))

            # what of each key the clips before a clip in the round's order have, taken or not
            kinds = {k: i for i, k in enumerate(["item", "clips", "spoken", "all", "low", *(f"g{i}" for i in range(len(self.kinds)))])}
            told = lambda kind, key, amount=F.lit(1.0): F.struct(F.lit(kinds[kind]).cast("byte").alias("kind"), key.alias("key"), amount.alias("value"))
            own = [told("clips", _key("clips", F.col("speaker"))), told("spoken", _key("spoken", F.col("speaker")), F.col("seconds")), told("all", _key("all", F.col("bucket")), F.col("seconds"))]
            own += [F.when(F.col("low"), told("low", _key("low", F.col("bucket"))))] + [F.when(F.col(f"g{i}").isNotNull(), told(f"g{i}", F.col(f"g{i}"))) for i in range(len(self.kinds))]
            parts = F.concat(F.transform("keys", lambda k: told("item", k)), F.filter(F.array(*own), lambda x: x.isNotNull()))
            place = F.struct((-F.col("score")).alias("s"), "clip_id", "cid")  # in the round's order
            if timed:  # many clips with many tokens: numbered in that order, and their keys written once
                near, place = placed(near, [F.desc("score"), F.col("clip_id"), F.col("cid")]).withColumnRenamed("__id", "at").drop("__part"), F.col("at")
            each = keyed.join(_sent(near, looked), "cid").select("cid", place.alias("at"), parts.alias("parts"))
            each = cut(each, "near") if timed else each
            each = each.select("cid", "at", F.explode("parts").alias("t")).select("cid", "at", "t.*")
            before = summed_before(each, ["key"], [F.col("at")], F.col("value"), "before").select("cid", "kind", "key", "before")
            before = before.join(counts, "key", "left")
            gain = F.sum(F.when(F.col("w").isNotNull(), value(F.col("w"), F.col("a"), F.col("n") + F.col("before")))).alias("safe")
            if self.taken is not None and self.kinds:
                held = self._counts("g0")
                for i in range(1, len(self.kinds)):
                    held = held.unionByName(self._counts(f"g{i}"))
                before = before.join(held.select("key", F.col("n").alias("m")), "key", "left")
            else:
                before = before.withColumn("m", F.lit(0).cast("long"))
            sums = before.groupBy("cid").agg(
                gain, *[F.max(F.when(F.col("kind") == kinds[k], F.col("before"))).alias(f"before_{k}") for k in ("clips", "spoken", "all", "low")],
                *[F.max(F.when(F.col("kind") == kinds[f"g{i}"], F.col("before") + F.coalesce("m", F.lit(0)))).alias(f"held{i}") for i in range(len(self.kinds))],
            )
            at = near.join(sums, "cid")
            safe = F.round(F.coalesce("safe", F.lit(0.0)) + extra((F.col("clips") == 0) & (F.col("before_clips") == 0)) - F.col("penalty"), DIGITS)
            fits = safe >= limit(1)
            if not timed:
                fits &= F.col("safe") > 0
            if lim.max_clips_per_speaker is not None:
                fits &= F.col("clips") + F.col("before_clips") < lim.max_clips_per_speaker
            if lim.max_duration_per_speaker is not None:
                fits &= F.col("spoken") + F.col("before_spoken") + F.col("seconds") <= lim.max_duration_per_speaker + 1e-9
            for i, kind in enumerate(self.kinds):
                fits &= F.col(f"g{i}").isNull() | (F.col(f"held{i}") < lim.duplicates[kind])
            if lim.max_low_quality_ratio is not None:
                fits &= ~F.col("low") | ((F.col("low0") + F.col("before_low") + 1) / (F.col("n0") + 1) <= lim.max_low_quality_ratio)
            if timed:
                left = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(float(u))) for b, u in self.until.items()], F.lit(0.0))
                so_far = F.col("s0") + F.col("before_all")
                fits &= (so_far < (1 - tol) * left) & (so_far + F.col("seconds") <= (1 + tol) * left)
            if not self.take(at.where(fits).withColumn("score", safe), why, looked):
                return

    def search(self, state: DataFrame) -> None:
        """Exchange chosen clips of the utility phase for ones outside, within working sets of bounded size a bucket: FREE
        clips that cost least to give up, OUTSIDE that would add most."""
        if self.taken is None or not self.weights.local_search_steps:
            return
        keyed = self.keyed
        counts = cut(state.select("key", "w", "a", "held").join(self._taken_keys(), "key", "left").na.fill({"n": 0}), "counts")
        at = F.col("a") + F.col("n")
        valued = counts.select("key", "held", (F.col("w") * F.log((at + 1) / at)).alias("more"), F.when(F.col("n") > 0, F.col("w") * F.log(at / (at - 1))).otherwise(0.0).alias("less"))
        sums = cut(_met(keyed, valued, _commonest(state)).groupBy("cid").agg(F.round(F.sum("more"), DIGITS).alias("more"), F.round(F.sum("less"), DIGITS).alias("less")), "sums")
        first = lambda rows, by, most: rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(by, "clip_id"))).where(F.col("r") <= most).select("cid")
        free = first(self.taken.where("why = 'utility'").join(sums, "cid"), F.col("less"), FREE).withColumn("free", F.lit(True))
        barred = F.col("action").isin("force_exclude", "return_to_reserve") | F.col("unfit")
        outside = first(self.rows.where(~barred).join(self.have("cid"), "cid", "left_anti").join(sums, "cid"), F.desc("more"), OUTSIDE).withColumn("free", F.lit(False))
        sets = cut(free.unionByName(outside), "sets")
        chosen = F.broadcast(sets)  # FREE + OUTSIDE rows a bucket
        items = keyed.join(chosen.select("cid"), "cid", "left_semi").select("cid", F.explode("keys").alias("key")).join(counts, "key").groupBy("cid").agg(F.collect_list(F.struct("key", "w", "a", "n")).alias("items"))
        speakers = self._counts("speaker").select(F.col("key").alias("speaker"), F.col("n").alias("clips"), F.col("s").alias("spoken"))
        rows = self.rows.join(chosen, "cid").join(items, "cid").join(speakers, "speaker", "left").na.fill({"clips": 0, "spoken": 0.0})
        for i in range(len(self.kinds)):
            rows = rows.join(self._counts(f"g{i}").select(F.col("key").alias(f"g{i}"), F.col("n").alias(f"m{i}")), f"g{i}", "left").na.fill({f"m{i}": 0})
        kinds, limits, weights, until, totals = self.kinds, self.limits, self.weights, self.until, self.totals()

        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ledger, utility, clips = Ledger(limits), Utility({}, 1.0), []
            ledger.n, ledger.low, ledger.total = totals.get(key[0], (0, 0, 0.0))
            for r in pdf.sort_values("clip_id").itertuples():
                groups = {k: getattr(r, f"g{i}") for i, k in enumerate(kinds) if not pd.isna(getattr(r, f"g{i}"))}
                ledger.clips[r.speaker], ledger.seconds[r.speaker] = r.clips, r.spoken
                for i, k in enumerate(kinds):
                    if k in groups:
                        ledger.groups[k, groups[k]] = getattr(r, f"m{i}")
                for x in r.items:
                    utility.targets[x["key"]], utility.t[x["key"]], utility.counts[x["key"]] = x["w"], x["a"], x["n"]
                clips.append({"clip_id": r.clip_id, "cid": r.cid, "speaker": r.speaker, "duration": r.seconds, "quality": r.quality if r.judged else None, "tokens": sorted(x["key"] for x in r.items), "groups": groups, "free": r.free})
            chosen = {i for i, c in enumerate(clips) if c["free"]}
            before = set(chosen)
            improve(clips, chosen, [i for i in range(len(clips)) if i not in before], set(), ledger, utility, until.get(key[0], 0.0), weights)
            moves = [(clips[i]["cid"], utility.gain(clips[i]["tokens"]), i in chosen) for i in sorted(before ^ chosen)]
            return pd.DataFrame(moves, columns=["cid", "score", "comes"])

        moves = cut(rows.groupBy("bucket").applyInPandas(kernel, "cid long, score double, comes boolean"), "moves")  # FREE + OUTSIDE rows a bucket
        if not moves.isEmpty():
            self.taken = cut(self.taken.join(moves.where("not comes").select("cid"), "cid", "left_anti"), "taken")
            self.take(self.rows.join(F.broadcast(moves.where("comes").select("cid", "score")), "cid"), "exchange", moves.count())

    def plan(self, state: DataFrame, needs: DataFrame | None) -> DataFrame:
        """A row a candidate in PLAN_FIELDS: what was taken, ranked and explained, and the rest by what it would add."""
        none = lambda kind: F.lit(None).cast(kind)
        keyed, counts, selected = self.keyed, state.select("key", "token", "w", "a", "held").withColumn("n", F.lit(0).cast("long")), None
        if self.taken is not None:
            place = F.when(F.col("why") == "forced", 0.0).otherwise(-F.col("score"))
            ranked = summed_before(self.taken, ["bucket"], [F.col("step"), place, F.col("clip_id")], F.lit(1).cast("long"), "before")
            ranked = cut(ranked.withColumn("rank", F.col("before") + 1).drop("before"), "ranked")
            each = ranked.select("cid", "rank", F.explode("keys").alias("key"))
            had = summed_before(each, ["key"], [F.col("rank")], F.lit(1).cast("long"), "n").join(state.select("key", "token", "w", "a"), "key")
            worth = F.col("w") * F.log((F.col("a") + F.col("n") + 1) / (F.col("a") + F.col("n")))
            told = had.select("cid", "token", worth.alias("worth"), F.substring_index("token", ":", 1).alias("family"))
            families = told.groupBy("cid", "family").agg(F.sum("worth").alias("s")).groupBy("cid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "s")))).alias("families"))
            reasons = told.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("worth")).alias("w"), "token"))), 1, 5).alias("top"))
            reasons = reasons.select("cid", F.transform("top", lambda t: F.struct(t["token"].alias("token"), (-t["w"]).alias("worth"))).alias("reasons"))
            speakers = ranked.groupBy("speaker").agg(F.min("rank").alias("heard"))
            new = F.when((F.col("heard") == F.col("rank")) & F.lit(bool(self.weights.speaker_bonus)), F.lit(float(self.weights.speaker_bonus)))
            good = F.when(F.col("judged") & F.lit(bool(self.weights.quality_bonus)), self.weights.quality_bonus * F.col("quality") / 100)
            parts = F.struct("score", F.coalesce("families", F.create_map().cast("map<string,double>")).alias("families"), F.coalesce("reasons", F.array().cast("array<struct<token:string,worth:double>>")).alias("reasons"), new.alias("speaker_diversity"), good.alias("quality"))
            selected = ranked.join(families, "cid", "left").join(reasons, "cid", "left").join(speakers, "speaker").select(
                "bucket", "clip_id", F.lit("selected").alias("disposition"), F.col("score").alias("selection_score"), F.col("rank").alias("selection_rank"), F.to_json(parts).alias("positive_contributions"),
                F.lit("{}").alias("penalties"), F.col("why").alias("selected_reason"), none("string").alias("reserve_reason"),
            )
            counts = counts.drop("n").join(self._taken_keys(), "key", "left").na.fill({"n": 0})
        at = F.col("a") + F.col("n")
        gains = _met(keyed, counts.select("key", "held", (F.col("w") * F.log((at + 1) / at)).alias("worth")), _commonest(state)).groupBy("cid").agg(F.round(F.sum("worth"), DIGITS).alias("gain"))
        rest = self.rows if self.taken is None else self.rows.join(self.have("cid"), "cid", "left_anti")
        rest = rest.select("cid", "bucket", "clip_id", "action").join(gains, "cid", "left").join(self.open(False).select("cid", F.lit(True).alias("fits")), "cid", "left")
        blocked = none("array<string>")
        if needs is not None:
            had = self.pool if self.taken is None else self.pool.join(self.have("cid"), "cid", "left_semi")
            have = had.select("bucket", F.explode("features").alias("feature")).groupBy("bucket", "feature").agg(F.count("*").alias("n")) if self.taken is not None else None
            short = needs.where("held >= a") if have is None else needs.where("held >= a").join(have, ["bucket", "feature"], "left").where(F.coalesce("n", F.lit(0)) < F.col("a"))
            held_up = self.pool.select("cid", "bucket", F.explode("features").alias("feature")).join(short.select("bucket", "feature"), ["bucket", "feature"]).groupBy("cid").agg(F.sort_array(F.collect_list("feature")).alias("blocked"))
            rest, blocked = rest.join(held_up, "cid", "left"), F.col("blocked")
        reason = F.when(F.col("action").isin("force_exclude", "return_to_reserve"), "barred by an override").when(F.col("fits"), "not needed").otherwise("limits")
        rest = rest.select(
            "bucket", "clip_id", F.lit("reserve").alias("disposition"), F.coalesce("gain", F.lit(0.0)).alias("selection_score"), none("long").alias("selection_rank"), F.lit("{}").alias("positive_contributions"),
            F.to_json(F.struct(blocked.alias("blocked"))).alias("penalties"), none("string").alias("selected_reason"), reason.alias("reserve_reason"),
        )
        return rest if selected is None else selected.unionByName(rest)


def select(candidates: DataFrame, targets: DataFrame, until: dict[str, float], limits: Limits = Limits(), constraints: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """Selected and reserve clips of each bucket, ranked, in PLAN_FIELDS.

    candidates: bucket, clip_id, speaker_id, duration_sec, quality_score, tokens ARRAY<STRING> (family:token), keys
    ARRAY<STRING> (coverage features), groups MAP<STRING,STRING>, override_action, and vector ARRAY<DOUBLE> if acoustic
    diversity has a weight; targets(family, token, target), constraints(feature, required, effective_minimum and perhaps
    weight). until: seconds by bucket. Forced clips come first, then what required features need, then filling by
    utility, then exchanges; the rest is the reserve.

    Greedy in rounds, for pools of any size alike: a round takes, in the order of their scores, all clips that still add
    a share of the best one's score, and keep every limit, after all clips before them in the round. The running sums of a round's
    tokens, speakers, groups and seconds go over ranges of one sort, so no task holds a bucket, a token or a speaker. Near
    clips of one round aren't held apart by acoustic diversity; those of different rounds are.
    """
    ship(candidates.sparkSession)
    pool, kinds = _pool(candidates, limits, bool(weights.acoustic))
    rounds = _Rounds(pool, kinds, until, limits, weights)
    token = F.col("token")
    weight = F.col("target") * _by_family(weights.families, 1.0, token)
    usual = weights.temperature if weights.temperature > 0 else 1.0
    # clips that hold a token are counted by its key, which the pool has; targets find their keys in each bucket
    key = _key("tokens", F.col("bucket"), token)
    found = F.broadcast(pool.select("bucket").distinct()).crossJoin(targets.select(F.concat_ws(":", "family", "token").alias("token"), "target")).withColumn("key", key)
    state = found.join(pool.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held")), "key")
    state = cut(state.select("key", "token", weight.cast("double").alias("w"), _by_family({f: t if t > 0 else 1.0 for f, t in weights.taus.items()}, usual, token).alias("a"), "held").where("w > 0"), "vocabulary")

    forced = cut(rounds.rows.where("action = 'force_include'"), "forced")
    n_forced = forced.count()
    alone = F.sum(F.col("w") * F.log((F.col("a") + 1) / F.col("a")))
    scores = rounds.keyed.join(_sent(forced.select("cid"), n_forced), "cid", "left_semi").select("cid", F.explode("keys").alias("key")).join(state, "key").groupBy("cid").agg(F.round(alone, DIGITS).alias("score"))
    rounds.take(forced.join(scores, "cid", "left").na.fill({"score": 0.0}), "forced", n_forced)
    needs = None
    if constraints is not None:
        own = F.col("weight") if "weight" in constraints.columns else F.lit(1.0)
        least = constraints.where("required and effective_minimum > 0").select("feature", F.col("effective_minimum").cast("double").alias("a"), own.cast("double").alias("weight"))
        usable = pool.where(~F.col("action").isin("force_include", "force_exclude", "return_to_reserve"))
        held = usable.select("bucket", F.explode("features").alias("feature")).groupBy("bucket", "feature").agg(F.count("*").alias("held"))
        needs = held.join(least, "feature").withColumns({"key": _key("features", F.col("bucket"), F.col("feature")), "w": F.col("weight") / F.sqrt(F.col("held") + 1) / F.col("a")})
        needs = cut(needs, "needs")
        extra = lambda new: 0.1 * F.col("quality") / 100 + 0.05 * new.cast("double") - 0.01 * F.col("seconds")
        rounds.phase("coverage", "features", needs, lambda w, a, n: w * F.greatest(a - n, F.lit(0.0)), extra, False)
    bonus = lambda new: weights.speaker_bonus * new.cast("double") + weights.quality_bonus * F.col("quality") / 100
    rounds.phase("utility", "tokens", state, lambda w, a, n: w * F.log((a + n + 1) / (a + n)), bonus, True)
    rounds.search(state)
    return rounds.plan(state, needs)


def limits_report(limits: Limits) -> str:
    return json.dumps(asdict(limits), sort_keys=True)
