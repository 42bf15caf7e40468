"""Runs of two and three neighbours in lists of tokens, counted as numbers.

The commonest words have numbers that every task knows. A place of a list is a 60-bit number of its word and the two after it;
a task counts the places of some million tokens and sends them, sorted and packed, to buckets by their pair, where pairs and
runs of three are counted. Only runs with another word, or one that holds the glue, travel as strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.scratch import cut, ship

#: Words that every task knows as numbers; tokens that a task takes apart at once; places of a bucket, about; runs of a packed row.
WORDS, STEP, PLACES, CHUNK = 1_000_000, 1_000_000, 1_000_000, 100_000
BITS = 20
LAST, PAIR = (1 << BITS) - 1, 2 * BITS

NUMBERED = pa.schema([("kind", pa.int8()), ("size", pa.int32()), ("packed", pa.binary()), ("token", pa.string()), ("n", pa.int64()), ("speakers", pa.int64()), ("clips", pa.int64())])
PACKED = "bucket int, kind byte, size int, packed binary, speakers array<string>, token string, speaker string, n long, clips long"
COUNTED = "kind byte, size int, packed binary, token string, n long, speakers long, clips long"


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A table's column in one piece."""
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else pa.array([], column.type) if isinstance(column, pa.ChunkedArray) else column


def _pack(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Rising keys by their differences, other columns as they are, byte by byte of equal weight, compressed."""
    columns = [np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), *(x.astype(np.uint32) for x in others)]
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(keys), c.itemsize).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int, others: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=size * (8 + 4 * others), codec="zstd"), np.uint8)
    column = lambda at, width, kind: np.ascontiguousarray(raw[at * size : (at + width) * size].reshape(width, size).T).view(kind).ravel()
    return [np.cumsum(column(0, 8, np.uint64), dtype=np.uint64).astype(np.int64), *(column(8 + 4 * i, 4, np.uint32).astype(np.int64) for i in range(others))]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _rows(**columns) -> pa.RecordBatch:
    """Rows of PACKED; columns that aren't given are null."""
    kinds = {"bucket": pa.int32(), "kind": pa.int8(), "size": pa.int32(), "packed": pa.binary(), "speakers": pa.list_(pa.string()), "token": pa.string(), "speaker": pa.string(), "n": pa.int64(), "clips": pa.int64()}
    n = len(next(iter(columns.values())))
    return pa.record_batch({k: pa.array(columns[k], t) if not isinstance(columns.get(k), pa.Array) else columns[k].cast(t) for k, t in kinds.items() if k in columns} | {k: pa.nulls(n, t) for k, t in kinds.items() if k not in columns}).select(list(kinds))


def _numbered(lists: pa.Array, speakers: pa.Array | None, words: pa.Array, glue: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED for some clips. Where speakers are given, a row of a run counts clips too, and speakers are told apart."""
    flat = lists.flatten()
    clip = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    if len(flat) < 2:
        return
    number = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    a, b, c = number[:-1], number[1:], np.append(number[2:], 0)
    pair = (clip[:-1] == clip[1:]) & known[:-1] & known[1:]
    three = pair & np.append(clip[2:] == clip[:-2], False) & np.append(known[2:], False)
    plain = pair & (a > 0) & (b > 0)
    whole = plain & three & (c > 0)
    spoken = speakers.dictionary_encode() if speakers is not None else None
    voice = spoken.indices.to_numpy(zero_copy_only=False).astype(np.int64) if spoken is not None else np.zeros(len(lists), np.int64)

    at = np.flatnonzero(plain)
    key, of = (a[at] << PAIR) | (b[at] << BITS) | np.where(whole[at], c[at], 0), clip[at]
    who = voice[of]
    if speakers is None:
        key.sort()
        starts = _starts(key)
        columns = [np.diff(starts, append=len(key))]
    else:
        first, by_pair = np.zeros(len(key), np.int64), np.argsort(key >> BITS, kind="stable")
        first[by_pair[_starts((key >> BITS)[by_pair], of[by_pair])]] = 1  # a pair's first place in its clip
        order = np.lexsort((key, who))
        key, who, of, first = key[order], who[order], of[order], first[order]
        clips = np.zeros(len(key), np.int64)
        clips[_starts(key, who, of)] = 1
        starts = _starts(key, who)
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        columns = [np.diff(starts, append=len(key)), add(clips), add(first)]
    key, who = key[starts], who[starts]
    bucket = _bucket(key >> BITS, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    key, who, bucket, columns = key[order], who[order], bucket[order], [x[order] for x in columns]
    edges = np.append(_starts(bucket), len(bucket))
    found: dict[str, list] = {"bucket": [], "size": [], "packed": [], "speakers": []}
    for i, j in zip(edges[:-1], edges[1:]):
        heard, local = np.unique(who[i:j], return_inverse=True)
        found["bucket"].append(bucket[i])
        found["size"].append(j - i)
        found["packed"].append(_pack(key[i:j], *(x[i:j] for x in columns), *([local] if spoken is not None else [])))
        found["speakers"].append(spoken.dictionary.take(pa.array(heard)).to_pylist() if spoken is not None else [])
    if found["bucket"]:
        yield _rows(**found)

    for kind, odd in ((0, pair & ~plain), (1, three & ~whole)):
        at = np.flatnonzero(odd)
        if not len(at):
            continue
        text = pc.binary_join_element_wise(*(flat.take(pa.array(at + k)) for k in range(2 + kind)), glue)
        told = pa.table({"token": text, "voice": voice[clip[at]], "clip": clip[at]}).group_by(["token", "voice", "clip"]).aggregate([([], "count_all")])
        told = told.group_by(["token", "voice"]).aggregate([("count_all", "sum"), ([], "count_all")])
        text = _one(told["token"]).dictionary_encode()
        spread = np.array([zlib.crc32(t.encode()) for t in text.dictionary.to_pylist()], np.int64)[text.indices.to_numpy(zero_copy_only=False)] % buckets
        names = spoken.dictionary.take(_one(told["voice"])) if spoken is not None else pa.nulls(len(told), pa.string())
        yield _rows(bucket=spread, kind=np.full(len(told), kind, np.int8), token=text.cast(pa.string()), speaker=names, n=_one(told["count_all_sum"]), clips=_one(told["count_all"]))


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut, or put together, so that their first column has about `most` tokens; a longer list stays whole."""
    kept, held = [], 0
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, before + most - held, "right")))
            kept.append(batch.slice(at, until - at))
            held, at = held + int(ends[until - 1] - before), until
            if held >= most or at < batch.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, held = [], 0
    if kept and (table := pa.Table.from_batches(kept).combine_chunks()).num_rows:
        yield table.to_batches()[0]


def _merged(table: pa.Table, marked: bool) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED for a bucket: its runs with occurrences, and where marked speakers and clips."""
    n_columns, out = (4 if marked else 1), []
    packed = [r for r in table.select(["size", "packed", "speakers"]).to_pylist() if r["packed"] is not None]
    if packed:
        parts = [_unpack(r["packed"], r["size"], n_columns) for r in packed]
        if marked:
            names = pa.array([s for r in packed for s in r["speakers"]], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = np.cumsum([0] + [len(r["speakers"]) for r in packed])
            for i, p in enumerate(parts):
                p[4] = names[at[i] : at[i + 1]][p[4]]
        columns = [np.concatenate(x) for x in zip(*parts)]
        del parts
        key, n = columns[0], columns[1]
        clips, first, who = columns[2:] if marked else (n, n, np.zeros(len(n), np.int64))
        for kind, keys, own in ((1, key[(key & LAST) > 0], clips[(key & LAST) > 0]), (0, key >> BITS, first)):
            chosen = (key & LAST) > 0 if kind else slice(None)
            order = np.lexsort((who[chosen], keys)) if marked else np.argsort(keys, kind="stable")
            keys, voice, m, own = keys[order], who[chosen][order], n[chosen][order], own[order]
            starts = _starts(keys)
            if not len(starts):
                continue
            heard = np.zeros(len(keys), np.int64)
            heard[_starts(keys, voice)] = 1
            sums = [np.add.reduceat(x, starts) for x in ((m, heard, own) if marked else (m,))]
            keys = keys[starts]
            for i in range(0, len(keys), CHUNK):
                out.append((kind, len(keys[i : i + CHUNK]), _pack(keys[i : i + CHUNK], *(x[i : i + CHUNK] for x in sums)), None, None, None, None))
    for r in out:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(r, NUMBERED)], schema=NUMBERED)
    odd = table.filter(pc.is_valid(table["token"]))
    if odd.num_rows:
        told = odd.group_by(["kind", "token", "speaker"]).aggregate([("n", "sum"), ("clips", "sum")])
        told = told.group_by(["kind", "token"]).aggregate([("n_sum", "sum"), ([], "count_all"), ("clips_sum", "sum")])
        none = lambda kind: pa.nulls(told.num_rows, kind)
        rows = pa.table([told["kind"], none(pa.int32()), none(pa.binary()), told["token"], told["n_sum_sum"], told["count_all"], told["clips_sum_sum"]], schema=NUMBERED)
        yield from rows.to_batches()


def runs(clips: DataFrame, words: DataFrame, tokens: str, names: Sequence[str], glue: str, speaker: str | None = None) -> DataFrame:
    """family, token, count of the runs of two and three neighbours in the lists `tokens`; with `speaker`, a column in which a
    missing one counts as one, also speaker_count and utterance_count. words: token, count of all tokens.

    What tasks have counted is written packed, so it may be read more than once.
    """
    spark, marked = clips.sparkSession, speaker is not None
    ship(spark)
    line, left, total = 0, WORDS, 0
    for r in words.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():  # a row a count
        left, total = left - r.n, total + r.n * r["count"]
        line = r["count"] if left < 0 and not line else line
    common = words.where((F.col("count") > line) & F.col("token").isNotNull() & ~F.contains("token", F.lit(glue))).select("token", "count").toArrow()
    common = common.take(pc.sort_indices(common, [("count", "descending"), ("token", "ascending")]))
    sent = spark.sparkContext.broadcast(_one(common["token"]).cast(pa.string()))
    buckets, step = total // PLACES + 1, STEP

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, step):
            yield from _numbered(lot.column(0), lot.column(1) if marked else None, sent.value, glue, buckets)

    def merged(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_merged(table, marked), NUMBERED)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = ["speaker_count", "utterance_count"] if marked else []
        row = lambda kind, token, *numbers: pa.record_batch([kind, token, *numbers], names=["family", "token", "count", *extra])
        for batch in batches:
            sizes, packed, kinds = batch.column("size").to_pylist(), batch.column("packed"), batch.column("kind").to_pylist()
            for i, size in enumerate(sizes):
                if size is None:
                    continue
                key, *numbers = _unpack(packed[i].as_py(), size, 3 if marked else 1)
                at = [key >> (BITS * k) & LAST for k in range(1 + kinds[i], -1, -1)]
                text = pc.binary_join_element_wise(*(sent.value.take(pa.array(x - 1)) for x in at), glue)
                yield row(pa.array(np.full(size, names[kinds[i]], object), pa.string()), text, *map(pa.array, numbers))
            odd = batch.filter(pc.is_valid(batch.column("token")))
            if odd.num_rows:
                family = pa.array([names[k] for k in odd.column("kind").to_pylist()], pa.string())
                yield row(family, odd.column("token"), odd.column("n"), *([odd.column("speakers"), odd.column("clips")] if marked else []))

    own = [F.col(tokens), *([F.coalesce(speaker, F.lit("")).alias("speaker")] if marked else [])]
    dealt = clips.where(F.size(tokens) > 1).select(*own).mapInArrow(numbered, PACKED).repartition(buckets, "bucket")
    counted = cut(dealt.groupBy("bucket").applyInArrow(merged, COUNTED), "runs")
    return counted.mapInArrow(told, "family string, token string, count long" + (", speaker_count long, utterance_count long" if marked else ""))
