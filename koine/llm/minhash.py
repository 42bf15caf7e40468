"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

In SuperMinHash an element draws one random permutation of the signature's slots, and in step j offers the value
j + u, with u uniform, to the slot that comes j-th. Slots keep their smallest value. Once all slots of a text hold
values below j + 1 no later step can change them, and it stops: large sets take a step or two.

Texts with equal sets form one class before any pair is made. Bands of the signatures deal classes into buckets.
Each class is compared with two members of each of its buckets, so the number of pairs stays linear however large a
bucket is. Where a bucket then still holds several components, the members outside its largest component ask for links
to that component and to one another. For each such component the documents of every shingle are counted once; an
asking member goes on only if enough of its shingles occur in another set there, since a link needs that many in one
set. Those that are left are compared in blocks, by an index of the block's shingles: no pair is capped or left out, and
none is written but links. Links are confirmed on the full sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship, text_slices, texts_of
from koine.llm.components import components

#: Slots in a band and bands: a pair of similarity 0.8 shares no bucket with a probability of 3e-6.
BAND, BANDS = 4, 24
SLOTS = BAND * BANDS
#: Members of a block where components are compared, rows of a bucket that one task joins.
BLOCK, PART = 256, 1024

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN) | _U(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `width` words; lower case for A-Z only.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    data = [t.encode().lower() for t in texts]
    flat = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    solid = ~_BLANK[flat]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    places = np.flatnonzero(solid)
    first = np.cumsum(lengths) - lengths
    terms = _BYTES[flat[places]] * powers[np.arange(len(places)) - np.repeat(first, lengths)]
    words = _mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _GOLDEN)
    sizes = np.array([len(d) + 1 for d in data], dtype=np.int64)
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    rolled, n = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64), len(words) - width + 1
    for j in range(width):
        if n > 0:
            rolled += words[j : j + n] * _powers(width)[j]
    rolled = _mix(rolled + _U(width))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = words[a:b]
            out.append(_mix((few * _powers(len(few))).sum(keepdims=True) + _U(len(few))))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (set, slot); infinite for an empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.full((len(sets), slots), np.inf)
    flat = values.ravel()
    elements, owner = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(slots):
        draw = _mix(elements + _U((j + 1) * int(_GOLDEN) % 2**64))
        offer = j + (draw >> _U(11)).astype(np.float64) * 2.0**-53
        place = j + (_mix(draw ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(slots - j)).astype(np.int64)
        if order is None:
            slot = place
        else:
            rows = np.arange(len(elements))
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, offer)
        going = (values.max(axis=1) >= j + 1) & (sizes > 0)
        more = going[owner]
        if not more.any():
            break
        if order is None:
            place = place[more]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(place), 1))
            order[np.arange(len(place)), place] = 0
        elif not more.all():
            order = order[more]
        if not more.all():
            elements, owner = elements[more], owner[more]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """Each slot in 16 bits, four slots to a long: the signature, and at once the buckets' keys by band."""
    short = _mix(values.view(np.uint64)).astype(np.uint16)
    return np.ascontiguousarray(short).view(np.int64).reshape(len(values), -1)


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(texts_of(part), width)
                keys = band_keys(signatures(sets))
                low = [int(s.sum()) if len(s) else 0 for s in sets]
                high = [int(_mix(s ^ _GOLDEN).sum()) if len(s) else 0 for s in sets]
                offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(low, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(high, dtype=np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "n_shingles", "low", "high", "bands"],
                )

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = [s.view(np.int64) for s in shingle_sets(texts_of(part), width)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _sets(pairs: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of all classes that share a bucket with another: each of them is in a pair."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = documents.join(nodes.hint("shuffle_hash"), "node").select("node", "text")  # at every size: texts aren't sorted
    return cut(texts.mapInArrow(_full_sets(width), "node long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _compare_blocks(percent: int):
    """Links between the asking rows of a block and its others, on full sets: for each asking row and component one.
    The others' shingles are indexed once; an asking row reads the entries of its own."""

    def compare(pdf):
        import pandas as pd

        asks, node, c = pdf["asks"].to_numpy(), pdf["node"].to_numpy(), pdf["c"].to_numpy()
        rest, out = np.flatnonzero(~asks), []
        sizes = np.array([len(x) for x in pdf["shingles"]])
        if len(rest):
            flat = np.concatenate([pdf["shingles"].iloc[r] for r in rest])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(rest)), sizes[rest])[order]
            for q in np.flatnonzero(asks):
                own = pdf["shingles"].iloc[q]
                low, high = np.searchsorted(flat, own, side="left"), np.searchsorted(flat, own, side="right")
                counts = high - low
                at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                shared = np.bincount(owner[at], minlength=len(rest))
                near = (100 * shared >= percent * (sizes[q] + sizes[rest] - shared)) & (c[rest] != c[q])
                found = rest[near]
                for r in found[np.unique(c[found], return_index=True)[1]]:
                    out.append((min(node[q], node[r]), max(node[q], node[r])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _in_blocks(every: DataFrame, asking: DataFrame, key: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """Compare the rows of asking with those of every that have the same key; both have key, node, c and the numbers of
    blocks, `rows` of every and `columns` of asking. A task holds one block of each."""
    place = [F.expr(f"cast(pmod(xxhash64(node), {n}) as int)") for n in ("rows", "columns")]
    others = every.join(sets, "node").select(*key, "node", "c", "shingles", F.lit(False).alias("asks"), place[0].alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"))
    ask = asking.join(sets, "node").select(*key, "node", "c", "shingles", F.lit(True).alias("asks"), F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), place[1].alias("j"))
    return others.unionByName(ask).groupBy(*key, "i", "j").applyInPandas(_compare_blocks(percent), "a long, b long").distinct()


def _asking(buckets: DataFrame, named: DataFrame) -> DataFrame:
    """top, node, c of the members of buckets that are outside their bucket's largest component, `top`. Rows of a bucket
    are joined in parts of about PART, by its size."""
    placed = buckets.filter("n > 3").join(named, "node", "left").select("band", "key", "n", "node", F.coalesce("c", "node").alias("c"))
    placed = cut(placed, "placed")
    parts = placed.groupBy("band", "key", "n", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("band", "key", "n").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all")).filter("top.k < all")
    split = F.expr(f"cast(ceil(n / {PART}) as int)")
    mixed = cut(mixed.select("band", "key", F.col("top.c").alias("top"), F.explode(F.sequence(F.lit(0), split - 1)).alias("part")), "mixed")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("node"), split).cast("int"))
    outside = dealt.join(mixed, ["band", "key", "part"]).filter("c != top")
    return cut(outside.select("top", "node", "c").distinct(), "asking")


def _hopeful(asking: DataFrame, every: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The asking rows of which enough shingles occur in another set of `every` with the same top. A link to any of them
    needs `percent` of an asking set in that one set alone, so no link is lost."""
    held = every.select("top", "node").join(sets, "node").select("top", F.explode("shingles").alias("shingle"))
    often = held.groupBy("top", "shingle").agg(F.count("*").alias("n")).filter("n > 1").select("top", "shingle")
    own = asking.join(sets, "node").select("top", "node", "c", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = own.join(often, ["top", "shingle"]).groupBy("top", "node", "c", "size").agg(F.count("*").alias("shared"))
    return shared.filter(100 * F.col("shared") >= percent * F.col("size")).select("top", "node", "c")


def _left_over(buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket: of its members outside its largest component, those that can have a
    link are compared with all of that component, and with one another."""
    named = found.select("node", F.col("component").alias("c"))
    asking = _asking(buckets, named)
    none = asking.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if asking.isEmpty():
        return none
    members = sets.select("node").join(named, "node", "left").select("node", F.coalesce("c", "node").alias("c"))
    members = cut(members.withColumn("top", F.col("c")).join(asking.select("top").distinct(), "top").select("top", "node", "c"), "members")
    asking = cut(_hopeful(asking, members.unionByName(asking), sets, percent), "hopeful")
    if asking.isEmpty():
        return none
    blocks = lambda n: F.expr(f"cast(ceil({n} / {BLOCK}) as int)")
    wanted = asking.groupBy("top").agg(F.count("*").alias("u"))
    sizes = members.groupBy("top").agg(F.count("*").alias("m")).join(wanted, "top")
    sizes = cut(sizes.select("top", blocks("(m + u)").alias("rows"), blocks("u").alias("columns")), "sizes")
    every = members.unionByName(asking).join(sizes, "top")
    return _in_blocks(every, asking.join(sizes, "top"), ["top"], sets, percent)


def _one_document(sketched: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the classes of rows that have one doc_id and different sets."""
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    twice = some.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x != y").select("doc_id")
    nodes = some.join(twice, "doc_id").join(classes.select(*key, "node"), key).select("doc_id", "node").distinct()
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents(doc_id, text).

    Two documents are linked where 100 * common shingles >= percent * shingles of either. component_id is the smallest
    doc_id reachable over links; kept marks it. Null texts and texts without words have no shingle and no link. Rows
    with one doc_id count as one document, whose links are those of any of its texts; a null doc_id stands alone by its
    text and has itself as component unless a row with an id has the same set. Other columns are ignored. Empty table:
    no rows.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text")
    sketched = docs.mapInArrow(_sketches(width), f"doc_id {kind}, n_shingles long, low long, high long, bands array<long>")
    sketched = cut(sketched, "sketches")
    key = ["n_shingles", "low", "high"]
    node = F.coalesce(F.min("doc_id").cast("long"), F.xxhash64(*key))
    classes = sketched.filter("n_shingles > 0").groupBy(*key).agg(node.alias("node"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")

    dealt = classes.select("node", F.posexplode("bands").alias("band", "key"))
    drawn = F.struct(F.xxhash64("node").alias("h"), "node")
    pivots = dealt.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(drawn).alias("p"), F.max(drawn).alias("q")).filter("n > 1")
    pivots = cut(pivots.select("band", "key", "n", F.array("p.node", "q.node").alias("pivots")), "pivots")
    buckets = cut(dealt.join(pivots, ["band", "key"]), "buckets")
    pairs = buckets.select("node", F.explode("pivots").alias("pivot")).filter("node != pivot")
    pairs = cut(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")

    # the text of a class is that of any of its documents
    of_node = docs.withColumn("node", F.col("doc_id").cast("long")).filter("node is not null")
    sets = _sets(pairs, of_node, width)
    links = cut(_confirmed(pairs, sets, percent).unionByName(_one_document(sketched, classes, key)), "links")
    found = components(links)
    more = cut(_left_over(buckets, found, sets, percent), "left-over")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = classes.join(found, "node", "left").select(*key, F.coalesce("component", "first").cast(kind).alias("component_id"))
    out = sketched.select("doc_id", *key).join(cut(named, "named"), key, "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents that near_duplicates() keeps, with all their columns; rows with one doc_id all stay."""
    report = near_duplicates(documents, width, percent).filter("kept").select("doc_id").distinct()
    stay = cut(report.withColumnRenamed("doc_id", "__stay"), "stay")
    return documents.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")
