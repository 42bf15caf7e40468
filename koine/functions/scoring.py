"""Scores of features, clips and speakers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diminishing(count: Column, weight, temperature: float) -> Column:
    """Utility of a count: weight * ln(1 + count / temperature)."""
    t = temperature if temperature > 0 else 1.0
    return F.lit(weight) * F.log(1 + count / F.lit(t))


def marginal(count: Column, weight, temperature: float) -> Column:
    """What one more adds."""
    t = temperature if temperature > 0 else 1.0
    return F.lit(weight) * F.log((t + count + 1) / (t + count))


def rarity(pool: Column) -> Column:
    return 1 / F.sqrt(F.greatest(pool, F.lit(0)) + 1)


def deficit_share(deficit: Column, target: Column) -> Column:
    return F.when(deficit > 0, deficit / F.greatest(target, F.lit(1))).otherwise(0.0)


def smoothed_rate(passes: Column, attempts: Column, overall: Column | float, strength: float = 10.0) -> Column:
    return (passes + strength * F.lit(overall)) / (attempts + strength)


def pass_probability(rate: Column, quality: Column, duration: Column, up: Column, down: Column, low: float = 0.05, high: float = 0.98) -> Column:
    """A speaker's rate, lowered for signs of a bad recording, within [low, high]. An undecodable clip gets low.

    quality: struct of decode_ok, clipping_ratio, silence_ratio, rms; a missing sign lowers nothing.
    """
    q = lambda name: quality.getField(name)
    cut = lambda bad, by: F.when(F.coalesce(bad, F.lit(False)), by).otherwise(1.0)
    p = rate * cut(q("clipping_ratio") > 0.01, 0.5) * cut(q("silence_ratio") > 0.6, 0.7) * cut((q("rms") < 0.005) | (q("rms") > 0.4), 0.75)
    p = p * cut((duration < 0.4) | (duration > 20), 0.8) * cut(down > 0, 0.85)
    p = F.when(F.coalesce(up >= 2, F.lit(False)), F.least(F.lit(1.0), p * 1.05)).otherwise(p)
    p = F.when(F.coalesce(q("decode_ok"), F.lit(False)), p).otherwise(0.0)
    return F.least(F.lit(high), F.greatest(F.lit(low), p))


def analysis_cost(duration: Column, base: float = 1.0, weight: float = 0.1) -> Column:
    return base + F.coalesce(duration, F.lit(0.0)) * weight


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the places where both lists have a number; 0 where none."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    squares = F.zip_with(a, b, lambda x, y: F.when(usable(x) & usable(y), (x - y) * (x - y)).otherwise(0.0).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def redundancy(distance: Column, weight: float) -> Column:
    """weight / (1 + distance to the nearest selected one); nothing without one."""
    return F.when(distance.isNull() | (distance == float("inf")), 0.0).otherwise(weight / (1 + distance))
