"""Reports over catalogs, plans and runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koine.functions.tokens import split_tokens
from koine.scratch import chunked


def js_distance(left: DataFrame, right: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) of two tables of non-negative values, for each group `by`.

    Both are normalised; a side without mass counts as zero everywhere. 0 for equal ones, sqrt(ln 2) for disjoint ones.
    """
    def share(df: DataFrame, name: str) -> DataFrame:
        totals = df.groupBy(*by).agg(F.sum(value).alias("__t"))
        return df.join(totals, by).select(*by, key, F.when(F.col("__t") > 0, F.col(value) / F.col("__t")).otherwise(0.0).alias(name))

    both = share(left, "p").join(share(right, "q"), [*by, key], "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when((F.col(x) > 0) & (m > 0), F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return both.groupBy(*by).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("p") + part("q")) / 2))).alias("js_distance"))


def coverage_summary(counts: DataFrame) -> DataFrame:
    """family, tokens, occurrences and js_distance of counts(family, token, count): how far each family's are from equal ones.

    All of it is told from how many tokens have each count, which a single pass over the counts gives; there are few of those.
    """
    alike = counts.groupBy("family", "count").agg(F.count("*").alias("k"))
    total = Window.partitionBy("family")
    alike = alike.withColumns({"__t": F.sum(F.col("k") * F.col("count")).over(total), "__n": F.sum("k").over(total)})
    p, q = F.when(F.col("__t") > 0, F.col("count") / F.col("__t")).otherwise(0.0), 1 / F.col("__n")
    part = lambda x: F.when(x > 0, x * F.log(x / ((p + q) / 2))).otherwise(0.0)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("k") * (part(p) + part(q)) / 2)))
    return alike.groupBy("family").agg(F.sum("k").alias("tokens"), F.sum(F.col("k") * F.col("count")).alias("occurrences"), distance.alias("js_distance"))


def js_to_uniform(counts: DataFrame) -> DataFrame:
    return coverage_summary(counts).select("family", "js_distance")


def rejection_summary(clips: DataFrame, lists: tuple[str, ...] = ("biphones", "triphones", "moras")) -> DataFrame:
    """Rejected clips and the features lost with them, by reason; a missing disposition counts as rejected."""
    lost = F.size(split_tokens(F.col("phonemes")))
    for name in lists:
        lost = lost + F.coalesce(F.greatest(F.size(name), F.lit(0)), F.lit(0))
    rejected = clips.where(~F.coalesce(F.col("disposition").isin("eligible", "selected", "reserve"), F.lit(False)))
    reason = F.coalesce(F.nullif(F.col("reject_reason"), F.lit("")), F.lit("unknown"))
    return rejected.groupBy(reason.alias("reason")).agg(F.count("*").alias("clips"), F.sum(lost).alias("lost_features"))


def compare_ids(left: DataFrame, right: DataFrame, key: str = "clip_id") -> DataFrame:
    """Each id of either run with where it is: only_left, only_right or both."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def compare_values(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two runs side by side: left, right, absolute delta."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full").withColumn("delta", F.coalesce("right", F.lit(0)) - F.coalesce("left", F.lit(0)))


def speaker_audit(selected: DataFrame, max_clips: int | None = None, max_duration: float | None = None, min_duration: float | None = None) -> DataFrame:
    """speaker_id, rule, value, bound of each bound that a speaker breaks, with a slack of 1e-6 on durations."""
    totals = selected.groupBy("speaker_id").agg(F.count("*").cast("double").alias("clips"), F.sum("duration_sec").alias("duration"))
    rules = []
    if max_clips is not None:
        rules.append(("max_clips", F.col("clips"), max_clips, F.col("clips") > max_clips))
    if max_duration is not None:
        rules.append(("max_duration_sec", F.col("duration"), max_duration, F.col("duration") > max_duration + 1e-6))
    if min_duration is not None:
        rules.append(("min_duration_sec", F.col("duration"), min_duration, F.col("duration") < min_duration - 1e-6))
    none = F.lit(None).cast("struct<rule:string,value:double,bound:double>")
    found = [F.when(bad, F.struct(F.lit(n).alias("rule"), v.alias("value"), F.lit(float(b)).alias("bound"))).otherwise(none) for n, v, b, bad in rules]
    return totals.select("speaker_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("speaker_id", "x.*")


LEAK_DIMENSIONS: dict[str, str] = {"speaker": "speaker_id", "audio": "audio_sha256", "sentence": "sentence_id", "text": "text_norm"}


def leakage(clips: DataFrame, policies: Mapping[str, str], dimensions: Mapping[str, str] = LEAK_DIMENSIONS) -> DataFrame:
    """dimension, key, splits, clips of keys that more than one split holds against their dimension's policy; splits is a
    list of (split, clips). Counted map-side first; `leaking_clips` lists them.

    forbid: no two splits may share a key; forbid_for_test: test may share none; allow: anything goes. Null and empty
    keys leak nothing. clips: clip_id, split and the dimensions' columns.
    """
    active = {d: c for d, c in dimensions.items() if policies.get(d, "forbid") != "allow"}
    if not active:
        active, empty = dict(list(dimensions.items())[:1]), True
    else:
        empty = False
    counts = _leak_rows(clips, active).groupBy("dimension", "key", "split").agg(F.count("*").alias("clips"))
    found = counts.groupBy("dimension", "key").agg(F.sort_array(F.collect_list(F.struct("split", "clips"))).alias("splits"), F.sum("clips").alias("clips"))  # an entry a split
    strict = [d for d in active if policies.get(d, "forbid") == "forbid"]
    bad = (F.size("splits") > 1) & (F.col("dimension").isin(strict) | F.array_contains("splits.split", "test"))
    return found.where(bad & ~F.lit(empty))


def _leak_rows(clips: DataFrame, dimensions: Mapping[str, str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key")) for d, c in dimensions.items()])
    return clips.select("clip_id", "split", F.explode(entries).alias("e")).select("clip_id", "split", "e.*").where("key is not null and key <> ''")


def leaking_clips(clips: DataFrame, found: DataFrame, dimensions: Mapping[str, str] = LEAK_DIMENSIONS) -> DataFrame:
    """dimension, key, split, part, items: the clips of leaking keys by split, in lists of bounded length."""
    rows = _leak_rows(clips, dimensions).join(found.select("dimension", "key"), ["dimension", "key"], "left_semi")
    return chunked(rows, ["dimension", "key", "split"], "clip_id")


def status_of_coverage(index_count: Column, eligible: Column, selected: Column, minimum: Column, desired: Column, conflict: Column) -> Column:
    """Where a feature's coverage stands after selection. minimum and desired are the configured ones; the effective
    ones are bounded by the eligible clips. A null index_count means that there is no index."""
    low, high = F.least(minimum, eligible), F.least(F.greatest(desired, minimum), eligible)
    absent = eligible <= 0
    return (
        F.when((index_count <= 0) & absent, "not_present_in_index")
        .when(absent & (index_count > 0), "not_present_in_eligible")
        .when(absent, "candidate_missing")
        .when((selected >= desired) & (desired > 0), "configured_target_satisfied")
        .when((selected >= minimum) & (minimum > 0) & (selected >= high), "desired_satisfied")
        .when((selected >= high) & (high > 0) & (high < desired), "corpus_limit_satisfied")
        .when((selected >= high) & (high > 0), "satisfied")
        .when((selected >= low) & (low > 0) & (selected < high), "desired_unsatisfied")
        .when((selected >= low) & (low > 0), "minimum_satisfied")
        .when((selected >= minimum) & (minimum > 0), "minimum_satisfied")
        .when((conflict | (selected < low)) & (eligible > selected), "selection_constraint_conflict")
        .otherwise("minimum_unsatisfied")
    )


def status_of_plan(target: Column, accepted: Column, candidates: Column, rate: Column, required: Column) -> Column:
    """Where a feature stands before a batch."""
    open_ = F.when(accepted >= target, "satisfied").when(candidates <= 0, "candidate_exhausted").when(accepted + candidates < target, "unreachable")
    return open_.when(accepted + candidates * rate + 1e-9 < target, "likely_unreachable").otherwise(F.when(required, "deficit").otherwise("optional"))


#: Statuses that leave a feature missing.
MISSING = ("not_present_in_index", "not_present_in_eligible", "candidate_missing", "minimum_unsatisfied", "selection_constraint_conflict")


def missing_features(audit: DataFrame) -> DataFrame:
    """Rows of an audit(feature, status, required, selected_count, minimum, eligible) that call for more clips."""
    low = F.least(F.col("minimum"), F.col("eligible"))
    absent = F.col("status").isin(*MISSING[:3])
    wanted = F.col("status").isin(*MISSING) & ~((F.col("selected_count") >= low) & (low > 0)) & (absent | (F.col("required") & (F.col("selected_count") < low)))
    return audit.where(wanted).select("feature", "status", F.when(low > 0, low).otherwise(F.col("minimum")).alias("required_count"), "selected_count")
