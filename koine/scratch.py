"""Tables written to the shared folder in spark.checkpoint.dir: lineage ends there."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a key that a window takes at most.
WINDOW_ROWS = 100_000

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster without a shared folder gets it by
    --py-files instead. For whatever runs functions of this package in workers."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    if not (named := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster it must be one that all machines share")
        named = tempfile.mkdtemp(prefix="koine-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor costs no
    recomputation. The table goes when the driver ends."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/koine-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return _read(spark, df.schema, path)


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._koine_path = path
    return out


def appended(df: DataFrame, to: DataFrame | None, name: str) -> DataFrame:
    """What cut() or appended() gave before, with the rows of df added to its folder; a table of its own for None."""
    if to is None:
        return cut(df, name)
    path = to._koine_path
    df.select(*to.columns).write.mode("append").parquet(path)
    return _read(df.sparkSession, df.select(*to.columns).schema, path)


def drop_scratch() -> None:
    """Delete every table that cut() has written."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended: nothing can be deleted through it
            return


atexit.register(drop_scratch)


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer partitions than there are cores, dealt anew before dear work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def placed(df: DataFrame, order: list) -> DataFrame:
    """df sorted by ranges and written, with each row's range `__part` and its place `__id`, which grows in the order."""
    rows = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    return cut(rows.withColumn("__part", F.shiftright("__id", 33)), "numbered")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Gapless numbers from 1 over the whole table in the order given, without bringing it to one task: ranges' sizes give
    the shifts."""
    rows = placed(df, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min("__id").alias("first"))  # a row a range
    shifts = shifts.select("__part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return rows.join(shifts, "__part").withColumn(name, F.col("__id") - F.col("first") + F.col("shift") + 1).drop("__id", "__part", "first", "shift")


def _held_apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys with at most WINDOW_ROWS rows, and those of the others; None for a side without keys. The keys of the
    others are at most a row in WINDOW_ROWS of df."""
    names = [F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)]
    large = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > WINDOW_ROWS)
    if not keys:
        return (df, None) if large.isEmpty() else (None, df)
    large = cut(large.select(*names), "large")
    if large.isEmpty():
        return df, None
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__h{i}"))
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def _summed_by_window(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0).cast(df.select(F.sum(value).alias("s")).schema[0].dataType)))


def _summed_by_ranges(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    rows = placed(df.withColumn("__value", value), [*map(F.col, keys), *order])
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "__part").agg(F.sum("__value").alias("s"))
    zero = F.lit(0).cast(rows.schema["__value"].dataType)
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    shifts = ranges.select(*names, F.col("__part").alias("__p"), F.coalesce(F.sum("s").over(before(*keys).orderBy("__part")), zero).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = F.coalesce(F.sum("__value").over(before(*keys, "__part").orderBy("__id")), zero)
    return rows.join(shifts, same).withColumn(name, own + F.col("__shift")).select(*df.columns, name)


def _summed(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> list[DataFrame]:
    small, large = _held_apart(df, keys)
    parts = [_summed_by_window(small, keys, order, value, name)] if small is not None else []
    return parts + ([_summed_by_ranges(large, keys, order, value, name)] if large is not None else [])


def summed_before(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """For each row the sum of `value` over the rows of its keys before it in the order; 0 for the first.

    A key of more than WINDOW_ROWS rows may lie in several ranges of a written sort: sums within (key, range) are shifted by
    those of the ranges before, so no task holds a hot key. All other keys go by a window each, without a written table,
    however many rows the hot ones have. Keys may be null.
    """
    return reduce(DataFrame.unionByName, _summed(df, keys, order, value, name))


def chunked(rows: DataFrame, keys: list[str], item: str, most: int = 1000) -> DataFrame:
    """keys, part, items: the items of each key, sorted, in lists of at most `most`, numbered from 0. rows: distinct."""
    lists = lambda at: at.groupBy(*keys, F.floor(F.col("__n") / most).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return reduce(DataFrame.unionByName, map(lists, _summed(rows.select(*keys, item), keys, [F.col(item)], F.lit(1).cast("long"), "__n")))
