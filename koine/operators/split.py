"""Assigning splits without leaks: by speaker, or by clip."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.operators.components import components
from koine.scratch import cut, summed_before

SPLITS = ("train", "val", "test")
#: What holds more than this share of all seconds is dealt one by one; there are at most 1 / LARGE of them.
LARGE = 1 / 400


def _emptiest(have: dict[str, float], wanted: dict[str, float], seconds: float) -> str:
    """The split that most is missing from once it has so many seconds more; of equals train, then the last by name."""
    return max(wanted, key=lambda s: (wanted[s] - have[s] - seconds, s == "train", s))


def water_filled(wanted: dict[str, float], have: dict[str, float], seconds: float) -> dict[str, float]:
    """What each split gets of `seconds` so that all come as near to what is wanted as they can: those that have too much
    get none, the others share in proportion to what they lack."""
    lack = {s: max(0.0, wanted[s] - have[s]) for s in wanted}
    total = sum(lack.values())
    return {s: seconds * x / total if total > 0 else seconds * wanted[s] / (sum(wanted.values()) or 1.0) for s, x in lack.items()}


def deal(items: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """item, split of items(item, seconds, held), each to one split; durations come near the ratios.

    Held ones train. Of the others those that are LARGE go in falling order each where most is missing, on the driver, as there
    is a bounded number of them; all smaller ones lie side by side in a seeded order and the splits cut that line where they are
    full, so no task sees all of it. A cut errs by half of what it falls into. Splits without a ratio get nothing, but
    train what is held.
    """
    items = cut(items.select("item", F.coalesce("seconds", F.lit(0.0)).cast("double").alias("seconds"), F.coalesce("held", F.lit(False)).alias("held")), "items")
    told = items.agg(F.sum("seconds").alias("all"), F.sum(F.when(F.col("held"), F.col("seconds"))).alias("held")).first()
    total, have = told["all"] or 0.0, {s: 0.0 for s in ratios} | {"train": told["held"] or 0.0}
    wanted = {s: r * total for s, r in ratios.items() if r > 0} or {"train": total}
    have = {s: have.get(s, 0.0) for s in wanted}
    bound = total * LARGE
    large = {}
    for r in sorted(items.where(~F.col("held") & (F.col("seconds") > bound)).collect(), key=lambda r: (-r.seconds, str(r.item))):  # 1 / LARGE rows at most
        large[r.item] = _emptiest(have, wanted, r.seconds)
        have[large[r.item]] += r.seconds
    small = items.where(~F.col("held") & (F.col("seconds") <= bound)).withColumn("order", F.xxhash64(F.lit(seed), "item"))
    left = small.agg(F.sum("seconds").alias("s")).first().s or 0.0
    line = summed_before(small, [], [F.col("order"), F.col("item")], F.col("seconds"), "before").withColumn("middle", F.col("before") + F.col("seconds") / 2)
    split, upto = F.lit(list(wanted)[-1]), left
    for s, x in reversed(water_filled(wanted, have, left).items()):
        split, upto = F.when(F.col("middle") < upto, s).otherwise(split), upto - x
    named = line.select("item", split.alias("split")).unionByName(items.where("held").select("item", F.lit("train").alias("split")))
    if large:
        kind = items.schema["item"].dataType.simpleString()
        named = named.unionByName(items.sparkSession.createDataFrame(sorted(large.items(), key=str), f"item {kind}, split string"))
    return named


def unseen_speaker(clips: DataFrame, protected: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """speaker_id, split: protected speakers train, the others are dealt by their seconds. A null speaker is the empty one."""
    name = lambda df: F.coalesce(df["speaker_id"], F.lit("")).alias("item")
    kept = protected.select(name(protected), F.lit(True).alias("held")).distinct()
    rows = clips.groupBy(name(clips)).agg(F.sum(F.coalesce("duration_sec", F.lit(0.0))).alias("seconds"))
    return deal(rows.join(kept, "item", "left"), ratios, seed).withColumnRenamed("item", "speaker_id")


#: The usual policies against leaks between splits, by column.
POLICIES = {"audio_sha256": "forbid", "sentence_id": "forbid", "text_norm": "forbid"}


def seen_speaker(clips: DataFrame, critical: DataFrame, ratios: dict[str, float], policies: dict[str, str] = POLICIES, seed: int = 0) -> DataFrame:
    """clip_id, split, warning. clips: clip_id, duration_sec, features ARRAY<STRING> and the policies' columns; critical:
    feature_type, feature.

    Clips that share a key of a dimension that is not `allow` are linked. Linked clips are for test together or not at all; of the others, those
    linked by a `forbid` dimension train together or not at all, so nothing leaks. A component with a critical feature
    trains: train has every clip of such a feature that there is. Components are dealt by their seconds; one that is longer than its
    split should be is told of in `warning`. Null and empty keys link nothing; repeated clip_ids are one clip.
    """
    rare = critical.select(F.concat_ws(":", "feature_type", "feature").alias("feature")).distinct()
    marked = clips.select("clip_id", F.explode("features").alias("feature")).join(rare, "feature").select("clip_id").distinct().withColumn("held", F.lit(True))
    active = [d for d, p in policies.items() if p != "allow"]
    keys = [F.when(F.col(d).isNotNull() & (F.col(d) != ""), F.xxhash64(F.lit(d), d)).alias(d) for d in active]
    rows = clips.select("clip_id", F.xxhash64("clip_id").alias("node"), F.coalesce("duration_sec", F.lit(0.0)).cast("double").alias("seconds"), *keys).join(marked, "clip_id", "left")
    rows = cut(rows.na.fill({"held": False}), "narrow")
    total = rows.agg(F.sum("seconds").alias("s")).first().s or 0.0

    def linked(df: DataFrame, dims: list[str]) -> DataFrame:
        """df with the `item` that its rows are dealt by."""
        if not dims:
            return df.withColumn("item", F.col("node"))
        links = df.select("node", F.explode(F.array(*dims)).alias("key")).where("key is not null")
        return df.join(components(links), "node", "left").withColumn("item", F.coalesce("component", "node")).drop("component")

    def dealt(df: DataFrame, dims: list[str], of: dict[str, float]) -> DataFrame:
        df = cut(linked(df, dims), "linked")
        items = cut(df.groupBy("item").agg(F.sum("seconds").alias("seconds"), F.max("held").alias("held")), "items")
        split = deal(items, of, seed).join(items.select("item", F.col("seconds").alias("whole")), "item")
        return cut(df.join(split, "item").drop("item"), "dealt")

    test, strict = ratios.get("test", 0.0), [d for d in active if policies[d] == "forbid"]
    if strict == active:
        both = dealt(rows, active, ratios)
    else:
        first = dealt(rows, active, {"train": 1 - test, "test": test})
        rest = {s: r for s, r in ratios.items() if s != "test"}
        share = sum(rest.values()) or 1.0
        second = dealt(first.where("split <> 'test'").drop("split", "whole"), strict, {s: r / share for s, r in rest.items()})
        both = first.where("split = 'test'").unionByName(second)
    most = F.coalesce(*[F.when(F.col("split") == s, F.lit(r * total)) for s, r in ratios.items()], F.lit(0.0))
    told = F.when((F.col("whole") > most) & (F.col("split") != "train"), F.concat(F.lit("linked clips hold "), F.round("whole", 3).cast("string"), F.lit(" seconds, more than the split should")))
    return both.select("clip_id", "split", told.alias("warning")).dropDuplicates(["clip_id"])


def single_speaker(clips: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    none = clips.sparkSession.createDataFrame([], "feature_type string, feature string")
    return seen_speaker(clips, none, ratios, {"audio_sha256": "forbid", "text_norm": "forbid"}, seed)


def by_utterances(counts: dict[str, int], ratios: dict[str, float], seed: int = 0) -> dict[str, str]:
    """The older speaker split: shuffled speakers fill test, then validation, up to their share of utterances."""
    names, total = sorted(counts), sum(counts.values())
    random.Random(seed).shuffle(names)
    out, have = {}, Counter()
    for s in names:
        split = next((x for x in ("test", "val") if have[x] + counts[s] <= ratios.get(x, 0) * total), "train")
        out[s] = split
        have[split] += counts[s]
    return out
