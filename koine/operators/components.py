"""Connected components of rows that share keys, by rounds of smallest-label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.scratch import cut

#: Rows of a key that share a salt in joins.
SALT = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, component of every node of links(node, key), longs: nodes with a key in common are in one component, named by
    its smallest node.

    Each round gives a key the smallest label of its nodes, counted map-side first, a node the smallest of its keys, and then every label its own label, so
    labels reach the end of a path in about as many rounds as its length has binary digits. Keys with many nodes are
    joined in salted parts. Rows may repeat; nulls link nothing and are left out.
    """
    links = links.where("node is not null and key is not null").select("node", "key")
    sizes = links.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("low"), F.max("node").alias("high"))
    sizes = sizes.select("key", "k", (F.col("low") != F.col("high")).alias("links"))
    salts = F.floor(F.col("k") / SALT) + 1
    by = cut(sizes.where("links").select("key", salts.alias("salts")), "keys")
    nodes = links.select("node").distinct().withColumn("component", F.col("node"))
    edges = cut(links.join(by, "key").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).distinct(), "edges")
    labels = cut(nodes, "labels")
    while True:
        told = edges.join(labels, "node")
        least = told.groupBy("key", "salts", "salt").agg(F.min("component").alias("m")).groupBy("key", "salts").agg(F.min("m").alias("m"))
        least = least.select("key", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        asked = edges.join(least, ["key", "salt"]).groupBy("node").agg(F.min("m").alias("m"))
        closer = cut(labels.join(asked, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("near")), "closer")
        jump = closer.select(F.col("node").alias("near"), F.col("near").alias("far"))
        after = cut(closer.join(jump, "near").select("node", F.least("near", "far").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
