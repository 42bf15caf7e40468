"""Planning which clips to analyse next for features that are short, and the loop around it."""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.functions.scoring import analysis_cost, deficit_share, pass_probability, rarity, smoothed_rate
from koine.operators.aggregates import coverage_counts
from koine.operators.filters import useful
from koine.operators.joins import deficits as short_of
from koine.operators.reports import status_of_plan
from koine.scratch import cut, ship


@dataclass(frozen=True)
class PlannerConfig:
    required_bonus: float = 2.0
    prior_strength: float = 10.0
    default_rate: float = 0.5
    min_probability: float = 0.05
    max_probability: float = 0.98
    cost_base: float = 1.0
    cost_per_second: float = 0.1
    min_batch: int = 20
    max_batch: int = 500
    safety: float = 1.5
    max_per_speaker: int = 20
    speaker_penalty: float = 0.2
    text_penalty: float = 1.0


def target_rows(targets: dict[str, int | dict], required_families: tuple[str, ...] = ("phoneme",)) -> list[tuple]:
    """(feature, minimum, desired, required, weight) of a target table: a number is minimum and desired at once."""
    rows = []
    for feature, spec in sorted(targets.items()):
        spec = {"minimum": spec} if isinstance(spec, int) else dict(spec)
        low = int(spec.get("minimum", spec.get("desired", 0)))
        required = bool(spec.get("required", feature.split(":")[0] in required_families))
        rows.append((feature, low, max(low, int(spec.get("desired", low))), required, float(spec.get("weight", 1.0))))
    return rows


def feature_gains(deficits: DataFrame, pool: DataFrame, config: PlannerConfig) -> DataFrame:
    """feature, gain of a clip with the feature: by deficit, rarity in the pool and whether it is required."""
    joined = deficits.join(pool.select("feature", F.col("count").alias("pool")), "feature", "left")
    weight = F.when(F.col("required"), config.required_bonus).otherwise(1.0)
    gain = weight * rarity(F.coalesce("pool", F.lit(0))) * deficit_share(F.col("deficit"), F.col("target"))
    return joined.select("feature", "deficit", "target", F.when(F.col("target") > 0, gain).otherwise(0.0).alias("gain"))


def pass_column(overall: float, config: PlannerConfig) -> Column:
    rate = F.when(F.col("attempts") > 0, smoothed_rate(F.col("passes"), F.col("attempts"), overall, config.prior_strength)).otherwise(overall)
    return pass_probability(rate, F.col("cheap_quality"), F.col("duration_sec"), F.col("up_votes"), F.col("down_votes"), config.min_probability, config.max_probability)


def pass_rates(index: DataFrame, stats: DataFrame, overall: float, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """The index with each clip's probability to pass and its cost."""
    rows = index.join(stats.withColumnRenamed("speaker_id", "client_id"), "client_id", "left")
    cost = F.greatest(analysis_cost(F.col("duration_sec"), config.cost_base, config.cost_per_second), F.lit(1e-6))
    return rows.withColumns({"probability": pass_column(overall, config), "cost": cost})


def first_scores(index: DataFrame, gains: DataFrame, stats: DataFrame, overall: float, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """clip_id, score and its parts of each clip before a batch has any: probability * gain / cost."""
    keys = index.select("clip_id", F.explode(F.array_distinct("feature_keys")).alias("feature"))
    gain = keys.join(gains.where("gain > 0"), "feature").groupBy("clip_id").agg(F.sum("gain").alias("gain"))
    rows = pass_rates(index.join(gain, "clip_id"), stats, overall, config).select("clip_id", "client_id", "gain", "probability", "cost")
    return rows.withColumn("score", F.col("probability") * F.col("gain") / F.col("cost"))


def batch_size(required_deficit: int, rate: float, candidates: int, config: PlannerConfig = PlannerConfig()) -> int:
    if required_deficit <= 0 or candidates <= 0:
        return 0
    wanted = math.ceil(required_deficit / max(rate, config.min_probability) * config.safety)
    return min(candidates, max(config.min_batch, min(config.max_batch, wanted)))


def pick_batch(clips: list[dict], gains: dict[str, tuple[int, float]], size: int, config: PlannerConfig, rest: float | None = None, before: Iterable[dict] = ()) -> list[tuple[str, float]]:
    """Greedy batch: a picked clip lowers its features' deficits, and the scores of its speaker and text.

    Scores only fall, so a candidate whose fresh score is still on top is the best; ties, to seven digits, by clip_id.
    gains: deficit and gain at that deficit by feature. clips: clip_id, speaker, text, keys, rate (probability / cost).
    before: clips that the batch has already. rest: a bound on the scores of candidates that aren't here; picking ends
    where one of them might be the better, but not before the first pick: the best of `clips` must be the best of all.
    """
    left, speakers, texts = {f: d for f, (d, _) in gains.items()}, Counter(), Counter()

    def put(c: dict) -> None:
        speakers[c["speaker"]] += 1
        texts[c["text"]] += 1
        for f in c["keys"]:
            if left.get(f, 0) > 0:
                left[f] -= 1

    def score(c: dict) -> float:
        if speakers[c["speaker"]] >= config.max_per_speaker:
            return 0.0
        gain = math.fsum(gains[f][1] * left[f] / gains[f][0] for f in c["keys"] if left.get(f, 0) > 0)
        spread = 1 + speakers[c["speaker"]] * config.speaker_penalty
        if c["text"]:
            spread *= 1 + texts[c["text"]] * config.text_penalty
        return gain * c["rate"] / spread

    for c in before:
        put(c)
    rank = lambda s: -float(np.float32(s))
    heap = [(rank(s), c["clip_id"], i) for i, c in enumerate(clips) if (s := score(c)) > 0]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < size:
        _, name, i = heapq.heappop(heap)
        fresh = score(clips[i])
        if fresh <= 0:
            continue
        if heap and (rank(fresh), name) > heap[0][:2]:
            heapq.heappush(heap, (rank(fresh), name, i))
            continue
        if out and rest is not None and fresh <= rest * (1 + 1e-6):
            break
        out.append((name, fresh))
        put(clips[i])
    return out


def _batch_kernel(size: int, config: PlannerConfig, rest: float | None):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {k["feature"]: (k["deficit"], k["gain"]) for keys in pdf["keys"] for k in keys}
        rows = pdf.sort_values("clip_id").itertuples(index=False)
        clips = [{"clip_id": r.clip_id, "speaker": r.speaker, "text": r.text, "rate": r.rate, "keys": sorted(k["feature"] for k in r.keys), "had": r.had} for r in rows]
        before = [c for c in clips if c["had"]]
        picked = pick_batch([c for c in clips if not c["had"]], known, size - len(before), config, rest, before)
        return pd.DataFrame([(n, c, s) for n, (c, s) in enumerate(picked, len(before) + 1)], columns=["rank", "clip_id", "score"])

    return kernel


def scores_after(clips: DataFrame, held: DataFrame, picked: DataFrame, config: PlannerConfig = PlannerConfig(), first: bool = False) -> DataFrame:
    """clip_id, score of the clips that still add something once those of picked(clip_id), a batch at most, are in.

    clips: clip_id, speaker, text (null for none), rate; held: clip_id, feature, deficit, gain of their features. With `first`,
    clips have a column first, their gain before anything is picked: then only rows of features that picked clips have, of which a
    batch has few, are summed anew, and no others are shuffled.
    """
    own = clips.join(F.broadcast(picked), "clip_id", "left_semi")
    taken = held.join(F.broadcast(picked), "clip_id", "left_semi").groupBy("feature").agg(F.count("*").alias("taken"))
    left = F.greatest(F.col("deficit") - F.coalesce("taken", F.lit(0)), F.lit(0))
    if first:
        lost = held.join(F.broadcast(taken), "feature").groupBy("clip_id").agg(F.sum(F.col("gain") * F.least("taken", "deficit") / F.col("deficit")).alias("lost"))
    else:
        gain = held.join(taken, "feature", "left").groupBy("clip_id").agg(F.sum(F.col("gain") * left / F.col("deficit")).alias("gain"))
    speakers = F.broadcast(own.groupBy("speaker").agg(F.count("*").alias("of_speaker")))  # at most a row a picked clip
    texts = F.broadcast(own.where("text is not null").groupBy("text").agg(F.count("*").alias("of_text")))
    rows = clips.join(F.broadcast(picked), "clip_id", "left_anti").join(speakers, "speaker", "left").join(texts, "text", "left").na.fill(0, ["of_speaker", "of_text"])
    spread = (1 + F.col("of_speaker") * config.speaker_penalty) * (1 + F.col("of_text") * config.text_penalty)
    rows = rows.where(F.col("of_speaker") < config.max_per_speaker)
    if first:  # what is lost of a gain to the last digit was all of it
        rest = F.col("first") - F.coalesce("lost", F.lit(0.0))
        rows = rows.join(lost, "clip_id", "left").withColumn("gain", F.when(rest > F.col("first") * 1e-12, rest).otherwise(0.0))
    else:
        rows = rows.join(gain, "clip_id")
    return rows.select("clip_id", (F.col("gain") * F.col("rate") / spread).alias("score")).where("score > 0")


#: Candidates that a round of plan_batch compares in one task.
WORKING_SET = 4000


def plan_batch(
    index: DataFrame, targets: DataFrame, counts: DataFrame, analyzed: DataFrame, stats: DataFrame, config: PlannerConfig = PlannerConfig(), size: int | None = None, working_set: int = WORKING_SET
) -> DataFrame:
    """rank, clip_id, score of the next batch: the greedy one among all candidates, in rounds.

    A round scores every candidate as the clips picked so far leave it, and picks among the best `working_set` as long as
    the pick is above what the best of the others had; scores only fall, so none of those can be better. A round picks at
    least its best clip: the batch is the same for every working set, and no task ever holds more rows than that and
    the batch. Texts are compared by their hashes; a missing speaker counts as one.
    """
    spark = index.sparkSession
    ship(spark)
    short = cut(short_of(targets.withColumnRenamed("desired", "target"), counts), "short")
    valid = index.where(~F.coalesce("invalidated", F.lit(False)))
    keys = valid.select("clip_id", F.array_distinct("feature_keys").alias("keys")).join(analyzed.select("clip_id"), "clip_id", "left_anti").select("clip_id", F.explode("keys").alias("feature"))
    helps = cut(keys.join(short.where("deficit > 0").select("feature"), "feature"), "helps")
    pool = helps.groupBy("feature").agg(F.count("*").alias("count"))
    gains = cut(feature_gains(short, pool, config).where("gain > 0").select("feature", "deficit", "gain"), "gains")
    held = cut(helps.join(gains, "feature"), "held")
    tried = stats.agg(F.sum("attempts"), F.sum("passes")).first()
    overall = tried[1] / tried[0] if tried[0] else config.default_rate
    if size is None:
        need = short.where("required").agg(F.sum("deficit")).first()[0] or 0
        size = batch_size(need, overall, helps.select("clip_id").distinct().count(), config)
    text = F.when(F.col("normalized_text") != "", F.sha2("normalized_text", 256)).alias("text")
    narrow = valid.select("clip_id", "client_id", text, "duration_sec", "up_votes", "down_votes", "cheap_quality")
    rate, speaker = F.col("probability") / F.col("cost"), F.coalesce("client_id", F.lit(""))
    first = held.groupBy("clip_id").agg(F.sum("gain").alias("first"))
    clips = cut(pass_rates(narrow.join(first, "clip_id"), stats, overall, config).select("clip_id", speaker.alias("speaker"), "text", rate.alias("rate"), "first"), "rates")

    fields, picked = "rank long, clip_id string, score double", []
    while len(picked) < size:
        had = spark.createDataFrame([(c,) for _, c, _ in picked], "clip_id string")
        best = scores_after(clips, held, had, config, True).orderBy(F.col("score").cast("float").desc(), "clip_id").limit(working_set + 1).collect()
        rest = best[working_set].score if len(best) > working_set else None
        of = spark.createDataFrame([(r.clip_id, False) for r in best[:working_set]] + [(c, True) for _, c, _ in picked], "clip_id string, had boolean")
        lists = held.join(F.broadcast(of), "clip_id").groupBy("clip_id").agg(F.collect_list(F.struct("feature", "deficit", "gain")).alias("keys"))
        rows = clips.join(F.broadcast(of), "clip_id").join(lists, "clip_id").withColumn("all", F.lit(0))
        new = [tuple(r) for r in rows.groupBy("all").applyInPandas(_batch_kernel(size, config, rest), fields).collect()]  # a batch
        picked += sorted(new)
        if not new or rest is None:
            break
    return spark.createDataFrame(picked, fields)


@dataclass
class LoopState:
    """What the loop knows after a round; written as JSON after each."""

    iteration: int = 0
    analyzed: list[str] = field(default_factory=list)
    attempts: dict[str, int] = field(default_factory=dict)
    passes: dict[str, int] = field(default_factory=dict)
    stop: str | None = None
    accepted: list[str] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None
    config_hash: str | None = None
    index_hash: str | None = None


def config_hash(targets: DataFrame, config: PlannerConfig) -> str:
    wanted = sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in targets.collect())
    return hashlib.sha256(json.dumps([wanted, asdict(config)], sort_keys=True, default=str).encode()).hexdigest()


def index_hash(index: DataFrame) -> str:
    """Of the clips and their features, whatever their order; two sums of hashes, so equal rows don't cancel."""
    row = [F.col(c) for c in ("clip_id", "client_id", "feature_keys")]
    sums = index.agg(F.count("*"), *[F.sum(F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(2**31))) for seed in (0, 1)]).first()
    return hashlib.sha256(json.dumps(list(sums)).encode()).hexdigest()


def standing(index: DataFrame, targets: DataFrame, accepted: DataFrame, analyzed: DataFrame, rate: float) -> DataFrame:
    """feature, target, accepted, candidates, required, status of each target."""
    short = short_of(targets.withColumnRenamed("desired", "target"), coverage_counts(index.join(accepted, "clip_id", "left_semi")))
    pool = coverage_counts(index.join(analyzed, "clip_id", "left_anti")).withColumnRenamed("count", "candidates")
    rows = short.join(pool, "feature", "left").na.fill(0, ["candidates"])
    status = status_of_plan(F.col("target"), F.col("accepted"), F.col("candidates"), F.lit(rate), F.col("required"))
    return rows.select("feature", "target", "accepted", "candidates", "required", status.alias("status"))


def top_deficits(rows: list, most: int = 5) -> list[list]:
    """The targets that lack most, required ones first."""
    lacking = sorted((not r.required, r.accepted - r.target, r.feature) for r in rows if r.accepted < r.target)
    return [[f, -d] for _, d, f in lacking[:most]]


#: How a loop may end.
STOPS = ("complete", "candidate_exhausted", "unreachable", "likely_unreachable", "analysis_budget_exceeded", "iteration_limit_reached", "cancelled", "failed", "dry_run")


@dataclass(frozen=True)
class LoopLimits:
    max_iterations: int = 50
    max_clips: int = 10_000
    max_audio_hours: float = 100.0


def _nothing_left(index: DataFrame, short: DataFrame, analyzed: DataFrame, rate: float) -> str:
    """Why no clip is planned although something required is short."""
    pool = coverage_counts(useful(index, short, analyzed)).withColumnRenamed("count", "candidates")
    needed = short.where("required and deficit > 0").join(pool, "feature", "left").na.fill(0, ["candidates"])
    counts = needed.agg(
        F.count_if(F.col("candidates") == 0).alias("none"), F.count_if((F.col("candidates") > 0) & (F.col("candidates") < F.col("deficit"))).alias("few"),
        F.count_if((F.col("candidates") >= F.col("deficit")) & (F.col("candidates") * rate + 1e-9 < F.col("deficit"))).alias("unlikely"),
    ).first()
    return "candidate_exhausted" if counts["none"] else "unreachable" if counts["few"] else "likely_unreachable" if counts["unlikely"] else "candidate_exhausted"


def run_loop(
    index: DataFrame, targets: DataFrame, analyze: Callable[[DataFrame], DataFrame], state_path: str, limits: LoopLimits = LoopLimits(), config: PlannerConfig = PlannerConfig(),
    dry_run: bool = False, cancelled: Callable[[], bool] = lambda: False,
) -> LoopState:
    """Plan a batch, analyse it, count what passed, until nothing required is short or no candidate helps.

    analyze: a table of clip_id to one of clip_id, passed. A state file at state_path is resumed with the clips that it
    accepted; one of other targets, config or index, or without accepted clips for its passes, raises ValueError. Ends
    with one of STOPS; where analyze raises, the state says so before the error goes on.
    """
    spark, path = index.sparkSession, Path(state_path)
    state = LoopState(**json.loads(path.read_text())) if path.exists() else LoopState()
    hashes = config_hash(targets, config), index_hash(index)
    if path.exists() and (state.config_hash, state.index_hash) != hashes:
        raise ValueError(f"{path} is of other targets, another config or another index")
    if len(state.accepted) != sum(state.passes.values()):
        raise ValueError(f"{path} doesn't hold the clips that passed")
    state.config_hash, state.index_hash = hashes
    state.stop = state.error = None
    save = lambda: path.write_text(json.dumps(asdict(state)))
    ids = lambda names: spark.createDataFrame([(x,) for x in names], "clip_id string")
    while True:
        done = ids(state.analyzed)
        stats = spark.createDataFrame([(s, n, state.passes.get(s, 0)) for s, n in sorted(state.attempts.items())], "speaker_id string, attempts long, passes long")
        counts = coverage_counts(index.join(ids(state.accepted), "clip_id", "left_semi"))
        short = short_of(targets.withColumnRenamed("desired", "target"), counts)
        need = short.where("required").agg(F.sum("deficit")).first()[0] or 0
        if not need:
            state.stop = "complete"
        elif state.iteration >= limits.max_iterations:
            state.stop = "iteration_limit_reached"
        elif len(state.analyzed) >= limits.max_clips or state.seconds / 3600 >= limits.max_audio_hours:
            state.stop = "analysis_budget_exceeded"
        elif cancelled():
            state.stop = "cancelled"
        batch = [] if state.stop else plan_batch(index, targets, counts, done, stats, config).orderBy("rank").collect()  # max_batch rows
        if not state.stop and not batch:
            tried = sum(state.attempts.values())
            state.stop = _nothing_left(index, short, done, sum(state.passes.values()) / tried if tried else config.default_rate)
        if not state.stop and dry_run:
            state.stop = "dry_run"
        if state.stop:
            break
        try:
            results = analyze(ids([r.clip_id for r in batch])).select("clip_id", "passed").join(index.select("clip_id", "client_id", "duration_sec"), "clip_id").collect()
        except Exception as e:
            state.stop, state.error = "failed", f"{type(e).__name__}: {e}"[:500]
            save()
            raise
        for r in results:
            state.attempts[r.client_id] = state.attempts.get(r.client_id, 0) + 1
            state.passes[r.client_id] = state.passes.get(r.client_id, 0) + int(r.passed)
            state.seconds += r.duration_sec or 0.0
        state.analyzed += [r.clip_id for r in batch]
        state.accepted += sorted(r.clip_id for r in results if r.passed)
        state.iteration += 1
        save()
    save()
    return state
