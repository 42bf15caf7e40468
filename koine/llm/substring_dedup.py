"""Suffix-array dedup: remove every byte that a string of 100 bytes covers which also starts earlier.

1. Every window of 100 bytes picks an anchor: the smallest hash among its 32-byte strings, the leftmost of equals.
   Equal windows pick the same anchor. A run of windows with one anchor is a segment.
2. An anchor that occurs once has no window twice. A bit map of fixed size marks the hashes of repeated anchors; the
   texts are read again and segments with a marked anchor go on, as digests.
3. Equal segments of an anchor count as one, at their earliest place, map-side first. Where several different
   segments share an anchor, they meet in a shard; its suffix array, by induced sorting, brings equal windows
   together, and permuted common prefixes of 100 bytes or more bound their classes. The earliest of a class is first.
4. An anchor with too many different segments for one shard has their windows anchored anew, by longer strings and in
   the end by themselves, so that no shard is unbounded and nothing is left out.
5. A window with a marked anchor that isn't first of its class is removed, with all bytes it covers.

The texts are shuffled once, at the end; before that, maps of marked anchors choose what leaves a task. A map never
misses an anchor. One that is marked by chance is solved like any other: all its windows are, wherever they are, so
the result is the same. As a map fills up, more leaves the tasks; MAP_BITS is the bound on what is broadcast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship, text_slices
from koine.llm.suffix_array import permuted_common_prefixes, suffix_array

#: Bytes of a window, and of the strings that anchor windows at each level.
WINDOW, LEVELS = 100, (32, 64, 100)
#: Bits of a map of anchors, in buckets of a native bit map each.
MAP_BITS, MAP_BUCKET = 1 << 27, 1 << 15
#: Different segments of an anchor that one shard takes, bytes that one suffix array takes.
SHARD, ARRAY_BYTES = 1000, 2 << 20
LAST = (1 << 63) - 1

_U = np.uint64
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _FACTORS[3]
    x = (x ^ (x >> _U(29))) * _FACTORS[1]
    return x ^ (x >> _U(32))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of `width` bytes (a multiple of 4, at least 8) in data."""
    n = len(data) - width + 1
    words = np.ascontiguousarray(np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data).data, strides=(1,)))
    at = [*range(0, width - 7, 8)]
    if at[-1] + 8 < width:
        at.append(width - 8)
    out = np.full(n, width, dtype=np.uint64)
    for k in at:
        out = (out ^ words[k : k + n]) * _FACTORS[0]
        out ^= out >> _U(31)
    return _mix(out)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window and number of windows of each segment of the texts data[starts:ends]."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return none
    width = LEVELS[level]
    hashes = _hashes(data, width)
    room = 40  # bits of the hash that are compared; the rest holds the place, at most 16 million
    packed = (hashes >> _U(64 - room) << _U(64 - room)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_smallest(packed, WINDOW - width + 1) & _U((1 << (64 - room)) - 1)).astype(np.int64)
    step = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - starts >= WINDOW
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - WINDOW + 1, -1)
    valid = np.cumsum(step[: len(anchor)]) > 0
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    begins[starts[long]] = True
    first = np.flatnonzero(begins)
    stops = valid & np.append(begins[1:] | ~valid[1:], True)
    return hashes[anchor[first]], first, np.flatnonzero(stops) + 1 - first


#: Bytes of texts that are anchored together, so that the arrays stay in a core's cache, and bytes of a longer text that
#: are: places fit into the bits that the hash leaves.
GROUP, PIECE = 1 << 18, 8 << 20


@dataclass
class Segments:
    """Segments as arrays: data and where in it they begin, the row of their text, their place in it, windows, hash."""

    data: np.ndarray
    begin: np.ndarray
    row: np.ndarray
    at: np.ndarray
    count: np.ndarray
    hash: np.ndarray

    def where(self, chosen: np.ndarray) -> Segments:
        return Segments(self.data, *(x[chosen] for x in (self.begin, self.row, self.at, self.count, self.hash)))

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the segments put together, and where each ends."""
        sizes = self.count + WINDOW - 1
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.begin - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends

    def packed(self) -> np.ndarray:
        """A run of windows in a long: first window times 256 and number of windows, at most 81."""
        return self.at << 8 | self.count


def document_segments(texts: list[bytes]):
    """Segments of texts by the first level's anchors; a long text comes in pieces that share no window."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE - WINDOW + 1):
            piece = text[at : at + PIECE]
            if parts and size + len(piece) > GROUP:
                yield _anchored(parts, rows, offsets)
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield _anchored(parts, rows, offsets)


def _anchored(parts: list[bytes], rows: list[int], offsets: list[int]) -> Segments:
    data, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    hashes, begin, count = segments(data, starts, ends, 0)
    text = np.searchsorted(ends, begin, side="right")
    return Segments(data, begin, np.array(rows)[text], np.array(offsets)[text] + begin - starts[text], count, hashes)


def refined(found: Segments, level: int) -> Segments:
    """The segments' windows by the anchors of this level."""
    data, ends = found.texts()
    starts = ends - (found.count + WINDOW - 1)
    hashes, begin, count = segments(data, starts, ends, level)
    of = np.searchsorted(ends, begin, side="right")
    return Segments(data, begin, found.row[of], found.at[of] + begin - starts[of], count, hashes)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse, modulo 2**64."""
    out = []
    for factor in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)):
        powers = np.full(size, factor, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def digests(found: Segments) -> np.ndarray:
    """A second 64-bit hash of each segment, of all its bytes, by a prefix array."""
    up, down = _powers(1 << max(20, len(found.data).bit_length()))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[found.data] * up[: len(found.data)])])
    spans = (sums[found.begin + found.count + WINDOW - 1] - sums[found.begin]) * down[found.begin]
    return _mix(spans + found.count.astype(np.uint64))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _FACTORS[2])


def _bytes_of(batch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray):
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a map marks."""
    slot = (hashes >> _U(20)) % _U(MAP_BITS)
    return bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & np.uint8(1) == 1


def _map_of(hashes: DataFrame):
    """A map of the column h, broadcast: MAP_BITS / 8 bytes at most."""
    slot = F.pmod(F.shiftrightunsigned("h", 20), F.lit(MAP_BITS))
    maps = hashes.select(F.floor(slot / MAP_BUCKET).cast("int").alias("b"), (slot % MAP_BUCKET).alias("bit"))
    bits = bytearray(MAP_BITS // 8)
    for r in maps.groupBy("b").agg(F.bitmap_construct_agg("bit").alias("m")).collect():
        bits[r.b * MAP_BUCKET // 8 : (r.b + 1) * MAP_BUCKET // 8] = r.m
    return hashes.sparkSession.sparkContext.broadcast(bytes(bits))


def _bits(broadcast) -> np.ndarray:
    return np.frombuffer(broadcast.value, dtype=np.uint8)


def _anchor_hashes(batches):
    """Each anchor of a text, once for each of its segments."""
    for batch in batches:
        for part in text_slices(batch):
            for found in document_segments(_bytes_of(part)):
                yield pa.RecordBatch.from_arrays([_signed(found.hash)], ["h"])


ROWS = "h long, sh long, doc long, rk long, at long"


def _columns(found: Segments, doc, rk, texts: bool):
    """The segments as rows of ROWS, and their bytes."""
    rows = pa.array(found.row)
    columns, names = [_signed(found.hash), _signed(digests(found)), doc.take(rows), rk.take(rows), pa.array(found.packed())], ["h", "sh", "doc", "rk", "at"]
    if texts:
        data, ends = found.texts()
        offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
        columns.append(pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]))
        names.append("segment")
    return pa.RecordBatch.from_arrays(columns, names)


def _marked_segments(marks, texts: bool):
    """Segments of documents whose anchor the map marks."""

    def run(batches):
        bits = _bits(marks)
        for batch in batches:
            for part in text_slices(batch):
                for found in document_segments(_bytes_of(part)):
                    yield _columns(found.where(_marked(bits, found.hash)), part.column("doc"), part.column("rk"), texts)

    return run


def _refined_segments(level: int):
    """The windows of segments by the anchors of this level."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "segment", GROUP):
                segment = [bytes(x) for x in part.column("segment").to_pylist()]
                sizes = np.array([len(x) for x in segment], dtype=np.int64)
                at = np.asarray(part.column("at"), dtype=np.int64) >> 8
                given = Segments(np.frombuffer(b"".join(segment), dtype=np.uint8), np.cumsum(sizes) - sizes, np.arange(len(sizes)), at, sizes - WINDOW + 1, np.zeros(len(sizes), dtype=np.uint64))
                yield _columns(refined(given, level), part.column("doc"), part.column("rk"), True)

    return run


def first_windows(pieces: list[bytes], docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the segments that are the earliest of their class: segment number, first window, number.

    pieces[i] starts at byte starts[i] of the document (docs[i], keys[i]); the order of windows is by these three.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = text.astype(np.int64) + 2
    symbols[ends] = 1
    symbols = np.append(symbols, 0)
    sa = suffix_array(symbols)
    shared = permuted_common_prefixes(symbols, sa, WINDOW)[: len(text)]
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    room = ends[owner] - np.arange(len(text))
    by = sa[1:]  # the first is the end mark
    by = by[room[by] >= WINDOW]
    if not len(by):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    # equal windows are neighbours: a suffix that ends sooner can't stand between two of them
    fresh = shared[by] < WINDOW
    fresh[0] = True
    offset = np.arange(len(text)) - (ends - sizes)[owner]
    order = np.lexsort((keys, docs))
    same = np.append(False, (docs[order][1:] == docs[order][:-1]) & (keys[order][1:] == keys[order][:-1]))
    rank = np.empty(len(pieces), dtype=np.int64)
    rank[order] = np.cumsum(~same)
    when = rank[owner[by]] << 32 | (starts[owner[by]] + offset[by])
    heads = np.flatnonzero(fresh)
    first = np.zeros(len(text) + 1, dtype=bool)
    first[by[when == np.repeat(np.minimum.reduceat(when, heads), np.diff(np.append(heads, len(by))))]] = True
    begin = np.flatnonzero(first & ~np.append(False, first[:-1]))
    stop = np.flatnonzero(first & ~np.append(first[1:], False)) + 1
    return owner[begin], offset[begin], stop - begin


def _shard_arrays(batches):
    """Sorted by anchor; whole anchors are gathered up to the size of a suffix array."""

    def solve(rows):
        segment, docs, keys, at = (list(x) for x in zip(*rows, strict=True))
        at = np.array(at, dtype=np.int64)
        docs, keys = np.array(docs, dtype=np.int64), np.array(keys, dtype=np.int64)
        owner, offset, count = first_windows(segment, docs, keys, at >> 8)
        begin = (at >> 8)[owner] + offset
        return pa.RecordBatch.from_arrays([pa.array(docs[owner]), pa.array(keys[owner]), pa.array(begin << 8 | count)], ["doc", "rk", "at"])

    held, size, last = [], 0, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("h", "segment", "doc", "rk", "at"))
        for h, *row in zip(*columns, strict=True):
            if h != last and size >= ARRAY_BYTES:
                yield solve(held)
                held, size = [], 0
            last = h
            held.append(row)
            size += len(row[0])
    if held:
        yield solve(held)


def _covered(size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of `size` places lie in one of the runs."""
    step = np.bincount(first, minlength=size + 1) - np.bincount(first + count, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def removed_bytes(size: int, runs: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which bytes of a text go: those under windows of `runs` that aren't in `kept`, both packed."""
    repeated = _covered(size, runs >> 8, runs & 255) & ~_covered(size, kept >> 8, kept & 255)
    windows = np.flatnonzero(repeated)
    return _covered(size, windows, np.full(len(windows), WINDOW))


def _results(repeated, full: bool):
    """What stays of each text, from the windows of repeated anchors and those of them that are first."""

    def run(batches):
        bits = _bits(repeated)
        for batch in batches:
            for part in text_slices(batch):
                texts, kept = _bytes_of(part), part.column("kept").to_pylist()
                runs: list[list[np.ndarray]] = [[] for _ in texts]
                for found in document_segments(texts):
                    found = found.where(_marked(bits, found.hash))
                    cuts = np.searchsorted(found.row, np.arange(len(texts) + 1))
                    for row in np.unique(found.row).tolist():
                        runs[row].append(found.packed()[cuts[row] : cuts[row + 1]])
                out = [[], [], [], []]
                for text, some, first in zip(texts, runs, kept, strict=True):
                    left, removed, spans = text, 0, 0
                    if some:
                        gone = removed_bytes(len(text), np.concatenate(some), np.array(first or [], dtype=np.int64))
                        left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                        removed, spans = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                    for column, x in zip(out, (len(text), removed, spans, left if full else hashlib.sha256(left).hexdigest()), strict=True):
                        column.append(x)
                last = pa.array(out[3], pa.binary() if full else pa.string())
                names = ["n_bytes", "n_removed", "n_spans", "kept_bytes" if full else "kept_sha256"]
                others = [c for c in part.schema.names if c not in ("text", "kept")] if not full else [c for c in part.schema.names if c != "kept"]
                columns = [*(part.column(c) for c in others), *(pa.array(x, pa.int64()) for x in out[:3]), last]
                yield pa.RecordBatch.from_arrays(columns, [*others, *names])

    return run


def _row_key() -> Column:
    """Tells apart rows with one doc_id; a row is known by its doc_id and this."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull())


def _order_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _first_windows(documents: DataFrame):
    """The map of repeated anchors and, of their windows, runs that are first of their class: doc, rk, at."""
    spark = documents.sparkSession
    docs = documents.select(_order_key().alias("doc"), _row_key().alias("rk"), "text").filter(F.octet_length("text") >= WINDOW)
    twice = docs.select("text").mapInArrow(_anchor_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = _map_of(twice)
    first = docs.mapInArrow(_marked_segments(repeated, False), ROWS).groupBy("h", "sh").agg(F.min(F.struct("doc", "rk", "at")).alias("f"))
    anchors = cut(first.groupBy("h").agg(F.count("*").alias("k"), F.min("f").alias("f")).select("h", "k", "f.doc", "f.rk", "f.at"), "anchors")
    kept = anchors.filter("k = 1").select("doc", "rk", "at")  # one segment only: nothing to compare it with
    rows = docs.mapInArrow(_marked_segments(_map_of(anchors.filter("k > 1")), True), f"{ROWS}, segment binary")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for level in range(len(LEVELS)):
        if level:
            rows = rows.mapInArrow(_refined_segments(level), f"{ROWS}, segment binary")
        earliest = F.min(F.struct("doc", "rk", "at", "segment")).alias("f")
        rows = cut(rows.groupBy("h", "sh").agg(earliest).select("h", "f.*"), "segments")
        if level:
            anchors = rows.groupBy("h").agg(F.count("*").alias("k"))
        hot = anchors.filter(F.col("k") > SHARD).select("h")
        shards, last = rows, level + 1 == len(LEVELS) or hot.isEmpty()
        if not last:
            hot = cut(hot, "hot")
            shards, rows = rows.join(hot, "h", "left_anti"), cut(rows.join(hot, "h", "left_semi"), "beyond")
        arrays = shards.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_shard_arrays, "doc long, rk long, at long")
        kept = kept.unionByName(cut(arrays, "arrays"))
        if last:
            break
    return repeated, kept


def _solved(documents: DataFrame, full: bool) -> DataFrame:
    """documents(..., __rk) with the results added and, unless full, without text."""
    ship(documents.sparkSession)
    repeated, kept = _first_windows(documents)
    lists = kept.groupBy("doc", "rk").agg(F.collect_set("at").alias("kept"))  # of one document
    of_row = (_order_key() == F.col("doc")) & (F.col("__rk") == F.col("rk"))
    both = documents.join(lists.hint("shuffle_hash"), of_row, "left").drop("doc", "rk")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if full or f.name != "text")
    last = "kept_bytes binary" if full else "kept_sha256 string"
    return both.mapInArrow(_results(repeated, full), f"{fields}, n_bytes long, n_removed long, n_spans long, {last}")


def substring_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents(doc_id, text).

    Texts are judged as UTF-8 bytes, null as empty; matches never cross documents. Rows with the same doc_id and text
    are one document and get the same result; of rows with one doc_id and different texts the order is by a hash of
    both; null ids come last. Other columns are ignored. Empty table: no rows.
    """
    return _solved(documents.select("doc_id", "text", _row_key().alias("__rk")), False).drop("__rk")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) with all their columns and n_bytes, n_removed, n_spans, kept_bytes added: the text's
    bytes that stay. They are bytes, not text: a removed window may begin or end inside a character."""
    base = documents.drop("n_bytes", "n_removed", "n_spans", "kept_bytes", "kept", "doc", "rk")
    return _solved(base.withColumn("__rk", _row_key()), True).drop("__rk")
