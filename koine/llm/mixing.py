"""Mixing sources to target weights, in DataFrame operations only: tokens a source, repetition rates, then
floor(rate) copies of each document and one more by a hash-seeded draw with the fraction as probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import WORD, cut, ranked

#: Weights dealt to the sources by code point, in turn.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from sized(source, size).

    The sources share `share` of all sizes by weight; none gets above `ceiling` times its own size, and the
    excess is shared again by weight among the others until none is above. Null is a source, the last one.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.repartitionByRange(64, F.col("source").asc_nulls_last())
    sources = cut(sources.withColumn("part", F.spark_partition_id()).withColumn("all", F.lit(0)), "sources")
    sources = ranked(sources.withColumn("last", F.col("source").isNull()), ["all"], F.col("part"), ["last", "source"])
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", dealt.cast("double").alias("weight")), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, F.lit(False)
    while True:  # ends: a source once capped stays capped
        taken, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~capped, F.col("weight"))),
            F.count(F.when(capped, 1)),
        ).first()
        if not weight:
            break
        level = (share * total - ceiling * taken) / weight
        capped = F.lit(level) * F.col("weight") > ceiling * F.col("source_size")
        if sources.filter(capped).count() == n:
            break
    free = F.lit(level if level is not None else 0.0) * F.col("weight")
    cap = ceiling * F.col("source_size")
    return sources.select("source", "source_size", F.when(capped, cap).otherwise(free).alias("target"))


def mixed_copies(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """documents(doc_id, text, source, ...) with their columns and size, source_size, target, copies added.

    A document's draw depends on its doc_id and the seed only, so reruns agree, and repeated rows of one
    doc_id share it. A source without words has rate 1: its documents stay once and add no words.
    Columns of these names in the input are replaced. Empty table: no rows.
    """
    sized = documents.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    narrow = cut(sized.select("source", "size"), "sizes")
    targets = source_targets(narrow, weights, share, ceiling).withColumnRenamed("source", "__source")
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return out.withColumn("copies", _copies(seed))


def _copies(seed: str) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_sources(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of documents as often as its copies say, with the columns of documents as they are."""
    rows = documents.select("doc_id", "text", "source", F.struct(*documents.columns).alias("__row"))
    out = mixed_copies(rows, weights, share, ceiling, seed)
    return out.select("__row", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("__row.*")


def mixing_report(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document. Texts are read once."""
    sized = cut(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized).withColumnRenamed("source", "__source")
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "size", "source_size", "target", (_copies(seed) * F.col("size")).alias("taken"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), dealt AS (
  SELECT source, source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources
), steps AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM dealt WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (SELECT max(level) FILTER (WHERE level <= ratio) AS level FROM steps),
targets AS (
  SELECT source, source_size, least(steps.weight * levels.level, 2.0::DOUBLE * source_size) AS target FROM steps, levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
