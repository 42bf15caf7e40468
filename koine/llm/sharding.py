"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that belong together share a hub (here: equal texts). Each starts on a shard drawn by hash. In each
round a hub counts its members by shard, and members ask to move to the shard, among those with room, where
most of them are, or to as many such shards as a large hub fills; a shard admits as many as its quota leaves, largest groups first. Links stay linear in the
number of documents: no pairs of members are made. At the end the quotas are met exactly: what a shard holds
beyond its quota, and all documents without links, fill the shards below theirs, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ranked, with_totals

#: Hub buckets by document buckets in which ranks are taken.
BUCKETS = 64
#: Members of a hub that share a salt in joins; parts in which a hub is counted.
SALT, SALTS = 512, 32


def balanced_label_propagation(docs: DataFrame, links: DataFrame, shards: int = 24, rounds: int = 6) -> DataFrame:
    """Assign each row of docs(node, ...) a `shard` from 0 and a `slot`, gapless from 0 in the shard.

    docs.node: unique long. links(node, hub): nodes with a hub in common are linked; a hub with one node links
    nothing; a node with several hubs follows its largest. Counts of shards differ by one at most.
    Empty docs: no rows. Ties between shards go to the smaller hash of (hub, shard).
    """
    spark = docs.sparkSession
    counted = with_totals(links.select("node", "hub"), ["hub"], "node", {"k": F.count("*")}, {"n": F.sum("k")}, SALTS)
    linked = (
        counted.filter("n > 1")
        .groupBy("node")
        .agg(F.max(F.struct("n", "hub")).alias("m"))
        .select("node", "m.hub", "m.n", F.expr(f"pmod(xxhash64(node), cast(ceil(m.n / {SALT}) as int))").alias("salt"), F.expr(f"cast(pmod(xxhash64(node, 24), {shards}) as int)").alias("label"))
    )
    linked = cut(linked, "linked")
    total = docs.count()
    quota = [total // shards + (b < total % shards) for b in range(shards)]
    for _ in range(rounds):
        moved = _round(linked, quota)
        if moved is None:
            break
        linked = cut(moved, "labels")

    bucket = F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)) * BUCKETS + F.pmod(F.xxhash64("node", F.lit(7)), F.lit(BUCKETS))
    stay = ranked(linked.select("node", "hub", "label"), ["label"], bucket, ["hub", "node"], "slot")
    stay = cut(stay.select("node", "label", "slot"), "stay")
    held = {r.label: r.n for r in stay.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a shard
    kept = {b: min(held.get(b, 0), quota[b]) for b in range(shards)}
    limits = spark.createDataFrame([(b, quota[b]) for b in range(shards)], "label int, quota long")
    placed = stay.join(F.broadcast(limits), "label").filter("slot < quota").select("node", F.col("label").alias("shard"), "slot")

    hubs = linked.select("node", "hub")
    free = docs.select("node").join(placed.select("node"), "node", "left_anti").join(hubs, "node", "left")
    free = ranked(free.withColumn("hub", F.coalesce("hub", F.xxhash64("node"))).withColumn("all", F.lit(0)), ["all"], bucket, ["hub", "node"])
    gaps, start = [], 0
    for b in range(shards):
        if quota[b] > kept[b]:
            gaps.append((b, start, start + quota[b] - kept[b], kept[b] - start))
            start += quota[b] - kept[b]
    shard, shift = F.lit(0), F.lit(0)
    for b, at, end, by in gaps:  # as many branches as shards
        inside = (F.col("rank") >= at) & (F.col("rank") < end)
        shard, shift = F.when(inside, b).otherwise(shard), F.when(inside, by).otherwise(shift)
    filled = free.select("node", shard.cast("int").alias("shard"), (F.col("rank") + shift).alias("slot"))
    return docs.join(placed.unionByName(filled), "node")


def _round(linked: DataFrame, quota: list[int]) -> DataFrame | None:
    """One round of moves; None where no document wants or is allowed to move."""
    spark, shards = linked.sparkSession, len(quota)
    votes = cut(linked.groupBy("hub", "n", "label").agg(F.count("*").alias("here")), "votes")
    load = {r.label: r.s for r in votes.groupBy("label").agg(F.sum("here").alias("s")).collect()}  # a row a shard
    open_ = [b for b in range(shards) if load.get(b, 0) < quota[b]]
    if not open_:
        return None
    entry = F.struct("here", F.xxhash64("hub", "label").alias("tie"), "label")
    by_hub = votes.groupBy("hub").agg(F.collect_list(entry).alias("all"), F.max("n").alias("n"))  # an entry a shard at most
    inviting = F.filter(F.sort_array("all", asc=False), lambda x: x["label"].isin(open_))
    shares = F.ceil(F.col("n") / max(1, min(quota))).cast("int")  # shards that a hub fills
    by_hub = by_hub.withColumns({"best": F.slice(inviting, 1, shares), "at": F.map_from_entries(F.transform("all", lambda x: F.struct(x["label"], x)))})
    by_hub = by_hub.filter("size(best) > 0 and size(at) > 1").select(
        "hub", "best", "at", F.explode(F.expr(f"sequence(0L, cast(ceil(n / {SALT}) as long) - 1)")).alias("salt")
    )
    asked = linked.join(by_hub, ["hub", "salt"], "left").withColumn("own", F.col("at")[F.col("label")])
    asked = asked.withColumn("best", F.expr("best[cast(pmod(xxhash64(node, 13), size(best)) as int)]"))
    wants = F.col("best.label").isNotNull() & (F.col("best") > F.col("own"))
    asked = asked.select(
        *linked.columns,
        F.when(wants, F.col("best.label")).alias("to"),
        F.when(wants, -F.floor(F.log2(F.col("best.here")))).cast("int").alias("band"),
        F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)).cast("int").alias("lot"),
    )
    asked = cut(asked, "asked")
    movers = asked.filter("to is not null")
    flow = movers.groupBy("label", "to").agg(F.count("*").alias("n")).collect()  # shards x shards rows at most
    if not flow:
        return None
    leaving = {b: sum(r.n for r in flow if r.label == b) for b in range(shards)}
    room = spark.createDataFrame([(b, max(0, quota[b] - load.get(b, 0) + leaving[b])) for b in range(shards)], "to int, room long")
    lots = movers.groupBy("to", "band", "lot").agg(F.count("*").alias("asking"))  # shards x 64 bands x 64 lots rows at most
    lots = lots.join(F.broadcast(room), "to").selectExpr(
        "to", "band", "lot", "(room - coalesce(sum(asking) over (partition by to order by band, lot rows between unbounded preceding and 1 preceding), 0)) / asking as share"
    )
    admitted = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    return asked.join(lots, ["to", "band", "lot"], "left").select(
        "node", "hub", "n", "salt", F.when(admitted, F.col("to")).otherwise(F.col("label")).alias("label")
    )


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Shard documents(doc_id, text) under the law `rows`; equal texts are linked.

    Null texts count as empty: 8 bytes, checksum 0. Repeated rows and null ids are placed like any other row;
    other columns are ignored, whatever their names. Empty table: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = documents.select(
        F.monotonically_increasing_id().alias("node"),
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    )
    base = cut(base, "shard-base")
    out = balanced_label_propagation(base.drop("hub"), base.select("node", "hub"), shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
