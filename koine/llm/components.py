"""Connected components of a table of links: union-find within each partition, then stars across partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship


def union_find(pairs) -> dict[int, int]:
    """Each node of the pairs and the smallest node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _forests(batches):
    pairs = ((a, b) for batch in batches for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
    found = [(x, r) for x, r in union_find(pairs).items() if x != r]
    if found:
        nodes, roots = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b) that isn't the smallest of its component; longs, no nulls.

    Each partition first shrinks its links to a forest. Then every node hands its larger neighbours, and after that
    its smaller ones, to the smallest of them, until all links lead to the smallest node of a component. That takes
    a number of rounds logarithmic in the size of the components. A hub's links are joined, never gathered.
    """
    ship(links.sparkSession)
    edges = cut(links.select("a", "b").filter("a != b").mapInArrow(_forests, "a long, b long"), "forests")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = cut(large, "large")  # every link leads down now
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a != b").distinct(), "small")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
