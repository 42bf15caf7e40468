"""Ranks, caps, pages and votes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koine.scratch import numbered


def cap(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def duplicate_cap(rows: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """The best rows of each duplicate group; rows in no group stay."""
    keyed = rows.where(F.col(key).isNotNull())
    return cap(keyed, [key], [F.desc(score), F.col("clip_id")], most).unionByName(rows.where(F.col(key).isNull()))


def reserve_ranking(rows: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """Rank by score, ties by clip_id; the head keeps that order, the tail is in the order of a seeded hash."""
    head = round(rows.count() * ratio)
    ranked = numbered(rows, [F.desc("score"), F.col("clip_id")], "reserve_rank").withColumn("in_head", F.col("reserve_rank") <= head)
    tail = numbered(ranked.where("not in_head").drop("reserve_rank"), [F.xxhash64(F.lit(seed), "clip_id"), F.col("clip_id")], "reserve_rank")
    return ranked.where("in_head").unionByName(tail.withColumn("reserve_rank", F.col("reserve_rank") + head))


def first_ids(rows: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first n distinct ids in the order of the file."""
    return rows.groupBy(column).agg(F.min(order).alias(order)).orderBy(order).limit(n)


def vote_winners(votes: DataFrame) -> DataFrame:
    """votes(src, dst, votes): each source's winner, its share, and whether the second has half its votes or more."""
    w = Window.partitionBy("src").orderBy(F.desc("votes"), "dst")
    ranked = votes.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("votes").over(w)).withColumn("total", F.sum("votes").over(Window.partitionBy("src")))
    best = ranked.where("n = 1")
    return best.select(
        "src", "dst", "votes", "total", (F.col("votes") / F.col("total")).alias("share"), F.coalesce(2 * F.col("second") >= F.col("votes"), F.lit(False)).alias("ambiguous")
    )


def top_votes(votes: DataFrame, most: int = 5) -> DataFrame:
    """src, place, dst, votes of each source's best targets."""
    w = Window.partitionBy("src").orderBy(F.desc("votes"), "dst")
    return votes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("src", "place", "dst", "votes")


def merge_suggestions(base: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """base(src, dst) with found(src, dst): missing entries are filled, known ones kept or overwritten."""
    joined = base.withColumnRenamed("dst", "old").join(found.select("src", F.col("dst").alias("new")), "src", "full")
    kept = F.coalesce("new", "old") if overwrite else F.coalesce("old", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull() | (F.col("old") == F.col("new")), "unchanged").otherwise("overwritten" if overwrite else "kept")
    return joined.select("src", kept.alias("dst"), change.alias("change"))


def random_split(rows: DataFrame, train: float, validation: float, seed: int = 0) -> DataFrame:
    """Splits by position in a seeded order, that of md5(seed:clip_id): floor(n * share) rows each, the rest is test."""
    n = rows.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    place = F.col("__place")
    split = F.when(place <= a, "train").when(place <= b, "val").otherwise("test")
    return numbered(rows, [F.md5(F.concat(F.lit(f"{seed}:"), "clip_id")), F.col("clip_id")], "__place").withColumn("split", split).drop("__place")


def nearest_vectors(rows: DataFrame, key: str, vector: str, queries: DataFrame | None = None, block: int = 256) -> DataFrame:
    """key, distance of each query vector to the nearest other row: a stated set of queries (all rows where none is named)
    against all rows, in blocks. A block of each meets as a product of matrices, which finds what can be nearest; those
    few distances are then taken as such. Places without a number in both are left out, as in `vector_distance`; a vector
    that is alone has no row."""
    asked = rows if queries is None else queries
    n = max(1, -(-asked.count() // block))
    numbers = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("v")
    packed = (
        asked.select(F.col(key).alias("id"), numbers).groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("m"))
        .select("b", F.col("m.id").alias("asked_ids"), F.col("m.v").alias("asked_vs"))
    )
    salt, salts = F.spark_partition_id(), rows.sparkSession.sparkContext.defaultParallelism
    each = rows.select(F.col(key).alias("id"), numbers).withColumn("s", F.pmod(F.xxhash64("id") + salt, F.lit(salts)).cast("int"))
    blocks = each.select("id", "v", "s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    both = packed.select("b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"), "asked_ids", "asked_vs")
    kind = rows.schema[key].dataType.simpleString()

    def kernel(_, asked: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(others):
            return pd.DataFrame({"id": [], "distance": []})
        ids, a = np.array(asked["asked_ids"].iloc[0]), np.stack(list(map(np.asarray, asked["asked_vs"].iloc[0]))).astype(np.float64)
        best = np.full(len(ids), np.inf)
        for start in range(0, len(others), 4 * block):
            some = others.iloc[start : start + 4 * block]
            best = np.minimum(best, nearest_rows(ids, a, some["id"].to_numpy(), np.stack(list(some["v"])).astype(np.float64)))
        return pd.DataFrame({"id": ids, "distance": best})

    met = both.groupBy("b", "s").cogroup(blocks.groupBy("b", "s")).applyInPandas(kernel, f"id {kind}, distance double")
    return met.where(F.col("distance") < float("inf")).groupBy(F.col("id").alias(key)).agg(F.min("distance").alias("distance"))


def nearest_rows(ids: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to the nearest row of b with another id."""
    here, there = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(here, a, 0.0), np.where(there, b, 0.0)
    squares = (x * x) @ there.T + here @ (y * y).T - 2 * (x @ y.T)
    squares[ids[:, None] == other[None, :]] = np.inf
    room = 1e-9 * ((x * x).sum(axis=1)[:, None].max(initial=1.0) + (y * y).sum(axis=1).max(initial=1.0))
    close = squares <= squares.min(axis=1, keepdims=True) + room  # what rounding can't tell apart
    close &= np.isfinite(squares)
    i, j = np.nonzero(close)
    out = np.full(len(a), np.inf)
    step = max(1, (1 << 22) // max(1, a.shape[1]))  # copies are all alike: many pairs
    for at in range(0, len(i), step):
        some = slice(at, at + step)
        np.minimum.at(out, i[some], np.sqrt(np.nansum((a[i[some]] - b[j[some]]) ** 2, axis=1)))
    return out
