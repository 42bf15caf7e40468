"""Embedding whitening from exact integer moments, cross-covariances by polarisation.

Vectors become integers. One pass counts them and sums each dimension; a second one sums, exactly, the squared centred
values of every dimension and of the sum of every two dimensions. Of the variances of a and b and of a + b, the last less
the others is twice the covariance of a and b. A task hands on one row for each pair of dimensions, so what is shuffled
and what the driver gets grows with the square of the dimension, not with the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship

#: Bits of a limb: exact sums of any size are handed on as limbs, which Spark sums as decimals.
LIMB = 62
#: Vectors of a task that are squared at a time.
ROWS = 4096
SUMS = "a int, b int, limb int, value long"


@dataclass(frozen=True)
class Whitening:
    """n vectors' sums by dimension, covariance (divisor n), eigenvalues falling, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def spread(self) -> np.ndarray:
        """Which components have a variance that rounding can't explain."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.values) * 2.0**-52

    def explained(self) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return self.values / total if total > 0 else np.full(len(self.values), np.nan)


def integers(vector: Column, scale: float = 1024.0, offset: int = 100_000) -> Column:
    """floor(scale * c) + offset of each entry as a long; null where the vector is null, or where an entry is null, not
    finite, or 2^61 or more once scaled, which no long would hold with its sums."""
    c = vector.cast("array<double>")
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < 2.0**61))
    return F.when(whole, F.transform(c, lambda x: F.floor(x * scale) + F.lit(offset).cast("long")))


def _matrix(column: pa.ListArray, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _blocks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part.column("__x"), wide)


def _limbs(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = []
    for (a, b), v in totals.items():
        sign, v, k = (1 if v >= 0 else -1), abs(v), 0
        while v:
            rows.append((a, b, k, sign * (v & ((1 << LIMB) - 1))))
            v, k = v >> LIMB, k + 1
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["a", "b", "limb", "value"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they hold it, else Python's."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    if n * max(abs(low), abs(high)) + max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def summed_squares(z: np.ndarray) -> list[int]:
    """The sum of squares of each column, exactly: where 64 bits can't hold it, of high and low halves."""
    if z.dtype == object:
        return [sum(v * v for v in column) for column in z.T.tolist()]
    top = int(np.abs(z).max()) if z.size else 0
    if top * top * max(1, len(z)) < 1 << 63:
        return (z * z).sum(axis=0).tolist()
    if top >= 1 << 60 or len(z) > 1 << 13:  # halves of 30 bits leave room for 2^13 of them
        return [sum(v * v for v in column) for column in z.T.tolist()]
    high, low = z >> 30, z & ((1 << 30) - 1)
    if int(np.abs(high).max()) >= 1 << 25:
        return [sum(v * v for v in column) for column in z.T.tolist()]
    parts = ((high * high).sum(axis=0).tolist(), (high * low).sum(axis=0).tolist(), [sum(c) for c in zip(*[(low[i : i + 4] * low[i : i + 4]).sum(axis=0).tolist() for i in range(0, len(z), 4)], strict=True)])
    return [(hh << 60) + (hl << 31) + ll for hh, hl, ll in zip(*parts, strict=True)]


def _gathered(x: DataFrame, per_block, wide: int) -> dict[tuple[int, int], int]:
    """Exact totals by pair over all rows: each task hands on one row a pair and limb, Spark sums them."""

    def partial(batches):
        totals: dict[tuple[int, int], int] = {}
        for _, block in _blocks(batches, wide):
            for pair, v in per_block(block):
                totals[pair] = totals.get(pair, 0) + v
        yield _limbs(totals)

    summed = x.select("__x").mapInArrow(partial, SUMS).groupBy("a", "b", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple[int, int], int] = {}
    for r in summed.toLocalIterator():  # a row a pair of dimensions and limb
        out[r.a, r.b] = out.get((r.a, r.b), 0) + (int(r.s) << (LIMB * r.limb))
    return out


def _usable(vectors: DataFrame, vector: str, scale: float, offset: int, dimension: int | None) -> tuple[DataFrame, int, int]:
    x = vectors.withColumn("__x", integers(F.col(vector), scale, offset)).filter("__x is not null")
    sizes = x.groupBy(F.size("__x").alias("d")).agg(F.count("*").alias("n"))
    if dimension is not None:
        sizes = sizes.filter(F.col("d") == dimension)
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (top.d, top.n) if top else (dimension or 0, 0)
    return x.filter(F.size("__x") == d), d, n


def fit(vectors: DataFrame, vector: str = "embedding", scale: float = 1024.0, offset: int = 100_000, dimension: int | None = None) -> Whitening:
    """Mean, covariance and components of all vectors of integers(); those of another length than `dimension`, or where
    that is None than most have (of equals, the longer), are left out. No vectors: n is 0 and all is empty."""
    ship(vectors.sparkSession)
    return _fit(*_usable(vectors.select(vector), vector, scale, offset, dimension))


def _fit(x: DataFrame, d: int, n: int) -> Whitening:
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros((d, d)), np.zeros(d), np.zeros((d, d)))

    def sums_of(block):
        small = int(np.abs(block).max()) < 1 << 50
        return (((i, i), v) for i, v in enumerate(block.sum(axis=0).tolist() if small else [sum(c) for c in block.T.tolist()]))

    sums = _gathered(x, sums_of, d)
    sums = [sums.get((i, i), 0) for i in range(d)]

    def squares_of(block):
        z = centred(block, n, sums)
        for a in range(d):
            own = summed_squares(z[:, a : a + 1])
            yield (a, a), own[0]
            if a + 1 < d:
                for b, v in enumerate(summed_squares(z[:, a + 1 :] + z[:, a : a + 1]), a + 1):
                    yield (a, b), v

    squares = _gathered(x, squares_of, d)
    covariance = np.zeros((d, d))
    for a in range(d):
        for b in range(a, d):
            alone = squares.get((a, a), 0)
            cross = alone if a == b else Fraction(squares.get((a, b), 0) - alone - squares.get((b, b), 0), 2)
            covariance[a, b] = covariance[b, a] = float(Fraction(cross) / n**3)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1].copy(), columns[:, ::-1].copy()
    largest = columns[np.abs(columns).argmax(axis=0), np.arange(d)]
    return Whitening(n, sums, covariance, values, columns * np.where(largest < 0, -1.0, 1.0))


def transform(vectors: DataFrame, fitted: Whitening, vector: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """Rows of vectors that fit can use, with `whitened` ARRAY<DOUBLE> of up to `components` entries and `deviation`, the
    exact sum over dimensions of (n * x - sum)^2, null beyond a long. A component without spread is null."""
    d = len(fitted.sums)
    if not d:
        return vectors.limit(0).withColumns({"deviation": F.lit(0).cast("long"), "whitened": F.array().cast("array<double>")})
    ship(vectors.sparkSession)
    x = vectors.withColumn("__x", integers(F.col(vector), scale, offset)).filter(F.size("__x") == d)
    k, n, sums, spread = min(components, d), fitted.n, fitted.sums, fitted.spread()
    by = np.where(spread, np.sqrt(np.where(spread, fitted.values, 1.0)), np.nan)[:k]
    projection, names = fitted.vectors[:, :k], vectors.columns
    schema = pa.schema([pa.field("deviation", pa.int64()), pa.field("whitened", pa.list_(pa.float64()))])

    def project(batches):
        for part, block in _blocks(batches, d):
            z = centred(block, n, sums)
            small = z.dtype != object and d * int(np.abs(z).max()) ** 2 < 1 << 63
            own = (z * z).sum(axis=1).tolist() if small else [sum(v * v for v in row) for row in z.tolist()]
            w = (z.astype(np.float64) / n) @ projection / by
            told = [pa.array([v if v < 1 << 63 else None for v in own], schema.field(0).type), pa.array([[None if np.isnan(v) else v for v in row] for row in w.tolist()], schema.field(1).type)]
            yield pa.record_batch([*[part.column(c) for c in names], *told], names=[*names, "deviation", "whitened"])

    kept = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)
    return x.mapInArrow(project, f"{kept}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, components: list[int]) -> float | None:
    """The largest absolute entry of the covariance of `whitened` less the identity, over the components named; two
    aggregates, the second centred by the means of the first."""
    if not n or not components:
        return None
    w = lambda i: F.col("whitened")[i]
    means = whitened.agg(*[F.avg(w(i)) for i in components]).first()
    pairs = [(i, j) for i in range(len(components)) for j in range(i, len(components))]
    products = whitened.agg(*[F.sum((w(components[i]) - means[i]) * (w(components[j]) - means[j])) for i, j in pairs]).first()
    return max(abs(p / n - (i == j)) for (i, j), p in zip(pairs, products, strict=True))


def whitening_report(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    embeddings(vec_id, embedding). Rows whose vector is null, holds a null or an entry that is not finite, or has another
    length than most, are dropped; empty vectors have no components, so no rows. Repeated rows and null ids count as they
    come; other columns are ignored, whatever their names. A component without spread (all vectors equal in it) has null
    as `whitened` and is left out of identity_error; where none has any, explained and identity_error are null. Empty table: no rows.
    Equal eigenvalues leave their components' order open; a component's largest entry is positive.
    """
    ship(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding")
    fitted = _fit(*_usable(rows, "embedding", 1024.0, 100_000, None))
    k = min(components, len(fitted.sums))
    named = transform(rows, fitted, components=components).select("vec_id", "deviation", "whitened")
    done = cut(named, "whitened")
    error = identity_error(done, fitted.n, [i for i in range(k) if fitted.spread()[i]])
    share = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in fitted.explained()[:k]]) if k else F.array().cast("array<double>")
    out = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
