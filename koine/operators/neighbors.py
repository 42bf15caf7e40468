"""The nearest other vector of every vector, exactly, with blocks ruled out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.operators.windows import nearest_rows, nearest_vectors
from koine.scratch import cut, ship, summed_before

#: Numbers of the vectors that meet in one task, on either side.
NUMBERS = 1 << 20


def nearest_all(rows: DataFrame, key: str, vector: str, pivots: int = 1024, block: int = 512) -> DataFrame:
    """key, distance of each vector to the nearest row with another key: every row against every row.

    A vector belongs to the cell of its nearest pivot; cells are cut into blocks of at most `block` rows by the distance to
    it. Its own block gives an upper bound. Another cell, and then another block, is met only where the triangle
    inequality leaves room for something nearer, so the result is that of comparing all. Copies find each other in their own block
    and go no further. Blocks lie together in parts, and a vector goes to a part once, however many of its blocks it meets.
    Pivots are at most `pivots`, and at most the square root of the rows. Vectors without clusters leave the inequality
    nothing to rule out: then all meet all, in parts.

    The inequality needs whole vectors. Those of another length than most have, or with entries that are null or not
    finite, are compared over the places that both have: in blocks, with all. Rows without a key or without a vector have
    no result, nor has a vector that is alone. Repeated keys give one row, the least distance.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    finite = lambda x: F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double")).otherwise(F.lit(float("nan")))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull()
    all_rows = cut(rows.where(usable).select(F.col(key).alias("id"), F.transform(vector, finite).alias("v")), "vectors")
    lengths = all_rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").collect()  # a row a length
    if not lengths:
        return all_rows.select(F.col("id").alias(key), F.lit(0.0).alias("distance"))
    whole = (F.size("v") == lengths[0].n) & ~F.exists("v", F.isnan)
    found = _whole(all_rows.where(whole), kind, pivots, block, max(1, lengths[0].n))
    width = max(r.n for r in lengths)
    padded = F.concat("v", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("v"))).alias("v")
    odd = all_rows.where(~whole).select("id", padded)
    if odd.limit(1).count():
        odd, even = cut(odd, "odd"), all_rows.where(whole).select("id", padded)
        found = found.unionByName(nearest_vectors(odd.unionByName(even), "id", "v", odd)).unionByName(nearest_vectors(odd, "id", "v", even))
    return found.groupBy(F.col("id").alias(key)).agg(F.min("distance").alias("distance"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.float64)


def _room(*vectors: np.ndarray) -> float:
    """What rounding may take from three distances told by squares: the root of their last bits."""
    return 3e-6 * max(float(np.sqrt((v * v).sum(axis=1).max(initial=0.0))) for v in vectors)


def _whole(rows: DataFrame, kind: str, pivots: int, block: int, width: int) -> DataFrame:
    n, most = rows.count(), max(block, NUMBERS // width)
    many = max(1, min(pivots, int(np.ceil(np.sqrt(n)))))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(many).collect()  # at most `pivots` vectors
    if not chosen:
        return rows.select("id", F.lit(0.0).alias("distance"))
    points = np.unique(np.array([r.v for r in chosen], dtype=np.float64), axis=0)
    middle = points.mean(axis=0)  # distances are told about it, which keeps squares small
    points -= middle

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for at in range(0, len(some), 1024):
                part = some.iloc[at : at + 1024]
                d = _distances(_stacked(part["v"]) - middle, points)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), r=d[np.arange(len(part)), cell])

    fields = f"id {kind}, v array<double>, cell int, r double"
    in_cells = cut(rows.mapInPandas(to_cells, fields), "cells")
    at = summed_before(in_cells, ["cell"], [F.col("r"), F.col("id")], F.lit(1).cast("long"), "place")
    blocks = at.withColumn("b", F.floor(F.col("place") / block)).drop("place").withColumn("row", F.monotonically_increasing_id())
    blocks = cut(blocks, "blocks")  # rows keep their numbers

    def own(some: pd.DataFrame) -> pd.DataFrame:
        v, ids = _stacked(some["v"]), some["id"].to_numpy()
        return some.assign(bound=nearest_rows(ids, v, ids, v))[["id", "v", "cell", "r", "row", "bound"]]

    bounded = cut(blocks.groupBy("cell", "b").applyInPandas(own, f"{fields}, row long, bound double"), "bounded")
    sizes = blocks.groupBy("cell", "b").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
    in_parts = summed_before(cut(sizes, "sizes"), [], [F.col("cell"), F.col("b")], F.col("n"), "before")
    ranges = cut(in_parts.select("cell", "b", "low", "high", F.floor(F.col("before") / most).alias("part")), "ranges")
    low, high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
    for c in ranges.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row a pivot
        low[c.cell], high[c.cell] = c.low, c.high

    def to_meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for at in range(0, len(some), 1024):
                part = some.iloc[at : at + 1024]
                v = _stacked(part["v"]) - middle
                d, room = _distances(v, points), _room(v, points)
                r, bound = part["r"].to_numpy()[:, None], part["bound"].to_numpy()[:, None]
                least = np.maximum(np.maximum(d - high, low - d), (d - r) / 2)  # the last: nearer to that pivot than to its own
                near = (least <= bound + room) & (high >= 0)
                cells, ds = [np.nonzero(x)[0].astype("int32") for x in near], [x[y] for x, y in zip(d, near, strict=True)]
                yield pd.DataFrame({"row": part["row"].to_numpy(), "reach": part["bound"].to_numpy() + room, "cells": cells, "ds": ds})

    open_ = bounded.where("bound > 0").select("row", "id", "v", "r", "bound")  # nothing is nearer than a copy
    cells = open_.select("row", "v", "r", "bound").mapInPandas(to_meet, "row long, reach double, cells array<int>, ds array<double>")
    cells = cells.select("row", "reach", F.explode(F.arrays_zip("cells", "ds")).alias("x")).select("row", "reach", F.col("x.cells").alias("cell"), F.col("x.ds").alias("d"))
    left = (F.col("d") - F.col("high") <= F.col("reach")) & (F.col("low") - F.col("d") <= F.col("reach"))
    met = cut(cells.join(ranges, "cell").where(left).select("row", "part").distinct(), "met")

    shares = met.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("row"), F.col("shares")).cast("int").alias("share")
    asked = met.join(shares, "part").select("row", "part", share).join(open_, "row").select("part", "share", "id", "v", "bound")
    there = blocks.join(ranges.select("cell", "b", "part"), ["cell", "b"]).join(shares, "part")
    there = there.select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "v", "cell", "b", "r")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Each vector against the blocks that its bound, which falls from block to block, leaves."""
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "distance": []})
        ids, v, best = a["id"].to_numpy(), _stacked(a["v"]), a["bound"].to_numpy(dtype=np.float64, copy=True)
        from_middle = v - middle
        room = _room(from_middle, points)
        for (cell, _), some in b.groupby(["cell", "b"]):
            d, r = _distances(from_middle, points[cell : cell + 1])[:, 0], some["r"].to_numpy()
            open_rows = np.nonzero((d - r.max() <= best + room) & (r.min() - d <= best + room))[0]
            other, w = some["id"].to_numpy(), _stacked(some["v"])
            for at in range(0, len(open_rows), 1024):
                i = open_rows[at : at + 1024]
                best[i] = np.minimum(best[i], nearest_rows(ids[i], v[i], other, w))
        return pd.DataFrame({"id": ids, "distance": best})

    nearer = asked.groupBy("part", "share").cogroup(there.groupBy("part", "share")).applyInPandas(meet, f"id {kind}, distance double")
    return nearer.unionByName(bounded.select("id", F.col("bound").alias("distance"))).where(F.col("distance") < float("inf"))
