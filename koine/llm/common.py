"""What the operators of this subpackage share: scratch tables, package shipping, two-level ranks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from koine.scratch import cut

ROOT = str(Path(__file__).resolve().parents[2])
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The white space that separates words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster without a shared
    folder gets it by --py-files instead. Texts are long: where the session leaves the number of rows of an Arrow batch
    at its default, it is lowered, so that a worker holds a few megabytes at a time."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def with_totals(df: DataFrame, key: list[str], by: str, partial: dict[str, Column], total: dict[str, Column], salts: int | None = None) -> DataFrame:
    """Each row of df with its group's totals. A group is counted and joined in `salts` parts, as many as the session has
    shuffle partitions, by a hash of the column `by`, so a hot one is spread over all tasks. partial: aggregates of a
    part; total: aggregates over its parts."""
    salts = salts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = cut(df.groupBy(*key, "__salt").agg(*[c.alias(n) for n, c in partial.items()]), "parts")
    whole = parts.groupBy(*key).agg(*[c.alias(n) for n, c in total.items()])
    named = parts.select(*key, "__salt").join(whole, key)  # `salts` rows of a group at most
    return df.join(named, [*key, "__salt"]).drop("__salt")


def ranked(df: DataFrame, part: list[str], bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within each value of `part`, in the order of (bucket, order).

    No task sees a whole part: rows are numbered within (part, bucket) and shifted by the number of rows
    in the buckets before it. `bucket` has a bounded number of values, so the table of shifts is bounded.
    """
    df = df.withColumn("__bucket", bucket)
    keys = [*part, "__bucket"]
    before = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    shifts = shifts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(shifts, keys)
        .withColumn(name, F.row_number().over(within) - 1 + F.col("__shift"))
        .drop("__bucket", "__shift")
    )


def text_slices(batch, column: str = "text", most: int = 2 << 20):
    """Cut an Arrow batch into runs of rows with about `most` bytes of text; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    lots, start = (np.cumsum(sizes) - 1) // most, 0
    for end in [*(np.flatnonzero(np.diff(lots)) + 1).tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
