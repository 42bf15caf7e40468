"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern that splits text is a small automaton over classes of code points. Each code point becomes a symbol
(its class and what follows it), each symbol a function from state to state. Functions compose associatively, so
their products along the text come from a blocked scan over ids of the automaton's transition monoid; the state
before a code point says whether a piece starts there. No regular expression runs. Pieces are slices of the
bytes, cached with their ids; those of a slice of text that the cache lacks are merged side by side, a merge of
each a round. The pieces' offsets in the stream of ids stay, and decoding goes by them.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from koine.llm.common import ship, text_slices, texts_of

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: Symbols: letter, number, other, apostrophe that starts a contraction of one or two letters if a piece can start
#: there, white space that is followed by white space or the end, a last space, another last white space.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_PREFIX, S_ALONE = range(8)
#: States: nothing open, a run of letters, numbers, others or white space, a space that belongs to what follows,
#: a contraction that lacks one or two letters.
CLOSED, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIXED, LACKS_ONE, LACKS_TWO = range(8)
#: Bytes of a piece up to which its ids are cached, and pieces in the cache before it starts anew.
CACHED_BYTES, CACHED_PIECES = 64, 100_000
#: Bytes of text that a worker takes apart at once: its arrays are a few dozen times that.
SLICE = 1 << 19
BLOCK = 64
#: Pieces that are merged side by side at most; what a pair has that is no token.
LOT, NONE = 1 << 13, np.iinfo(np.int32).max


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece starts at it."""
    if symbol == S_INNER:
        return BLANKS, state != BLANKS
    if symbol == S_PREFIX:
        return PREFIXED, True
    if symbol == S_ALONE:
        return CLOSED, True
    if symbol == S_LETTER:
        if state in (LACKS_ONE, LACKS_TWO):
            return (CLOSED if state == LACKS_ONE else LACKS_ONE), False
        return LETTERS, state not in (LETTERS, PREFIXED)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, PREFIXED)
    if state in (OTHERS, PREFIXED):
        return OTHERS, False
    return {S_OTHER: OTHERS, S_SHORT: LACKS_ONE, S_LONG: LACKS_TWO}[symbol], True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, ...]:
    """Ids of all products of the symbols' functions: product table, function table, starts by (symbol, state).

    Symbol + 8 is the same symbol at the start of a text, where no state carries over. Id 0 is the identity.
    """
    functions = [tuple(range(8))]
    for symbol in range(16):
        functions.append(tuple(_step(CLOSED if symbol >= 8 else s, symbol % 8)[0] for s in range(8)))
    symbols = functions[1:]
    functions = list(dict.fromkeys(functions))
    seen = {f: i for i, f in enumerate(functions)}
    for f in functions:  # grows while it is walked
        for g in symbols:
            if (h := tuple(g[x] for x in f)) not in seen:
                seen[h] = len(functions)
                functions.append(h)
    table = np.array(functions, dtype=np.uint8)
    n = len(functions)
    product = np.array([[seen[tuple(b[x] for x in a)] for b in functions] for a in functions], dtype=np.uint16)
    starts = np.array([[_step(CLOSED if s >= 8 else q, s % 8)[1] for q in range(8)] for s in range(16)], dtype=bool)
    return product.ravel(), table.ravel(), starts.ravel(), np.array([seen[g] for g in symbols], dtype=np.uint16), np.int32(n)


def _scan(ids: np.ndarray) -> np.ndarray:
    """Products of all ids before each place."""
    product, _, _, _, n = _monoid()
    if len(ids) <= BLOCK:
        out, now = np.zeros(len(ids), dtype=np.uint16), 0
        for i, x in enumerate(ids.tolist()):
            out[i] = now
            now = product[now * n + x]
        return out
    rows = -(-len(ids) // BLOCK)
    blocks = np.zeros((BLOCK, rows), dtype=np.int32)
    padded = np.zeros(rows * BLOCK, dtype=np.uint16)
    padded[: len(ids)] = ids
    by_place = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    now = np.zeros(rows, dtype=np.int32)
    for j in range(BLOCK):
        blocks[j] = now
        now = product.take(now * n + by_place[j]).astype(np.int32)
    before = _scan(now.astype(np.uint16)).astype(np.int32)
    return product.take(before[None, :] * n + blocks).T.ravel()[: len(ids)]


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library itself tells: what it matches of all of them."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        ids = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), dtype=np.uint32)] = kind
    table[0x20] = SPACE
    return table


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in concatenated texts. codes: code points; first: places at which texts start."""
    _, table, starts, symbol_id, _ = _monoid()
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    kind = codepoint_classes()[codes]
    opens = np.zeros(len(codes) + 1, dtype=bool)
    opens[first] = True
    opens[-1] = True
    blank = kind >= SPACE
    inner = np.append(blank[1:], True) | opens[1:]
    symbol = np.where(blank, np.where(inner, S_INNER, np.where(kind == SPACE, S_PREFIX, S_ALONE)), kind).astype(np.uint8)
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        padded = np.append(codes, [0, 0]).astype(np.int64)
        ends = np.append(opens, True)
        one = np.where(ends[marks + 1], 0, padded[marks + 1])
        two = np.where(ends[marks + 1] | ends[marks + 2], 0, padded[marks + 2])
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pairs = [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]
        symbol[marks[np.isin(one << 32 | two, pairs)]] = S_LONG
    symbol[opens[:-1]] += 8
    state = table.take(_scan(symbol_id[symbol]).astype(np.int32) * 8 + CLOSED)
    return np.flatnonzero(starts.take(symbol.astype(np.int32) * 8 + state))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the whole if it is a token, else merges of the lowest rank, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= CACHED_BYTES:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(a + b, 1 << 62) for a, b in pairwise(parts)]
        while pairs and (low := min(pairs)) < 1 << 62:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 62)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 62)
        return [ranks[p] for p in parts]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array([*pairs, np.iinfo(np.int64).max], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array([*pairs.values(), NONE], dtype=np.int32)[order]
        self.of_bytes = self.pair(np.repeat(self.single, 256), np.tile(self.single, 256))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two make, also its rank; NONE where they make none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; what the cache lacks is told once."""
        if len(self) >= CACHED_PIECES:
            self.clear()
        known = list(map(self.get, pieces))
        new = dict.fromkeys([p for p, ids in zip(pieces, known, strict=True) if ids is None])
        short = []
        for p in new:
            if (rank := self.ranks.get(p)) is not None:
                new[p] = rank.to_bytes(4, "little")
            elif len(p) <= CACHED_BYTES:
                short.append(p)
            else:
                new[p] = np.array(merge(p, self.ranks), dtype="<u4").tobytes()
        new.update(zip(short, self._merge_all(short), strict=True))
        self.update((p, ids) for p, ids in new.items() if len(p) <= CACHED_BYTES)
        return [new[p] if ids is None else ids for p, ids in zip(pieces, known, strict=True)]

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of at most CACHED_BYTES, in their order; those of similar length side by side."""
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        data = np.frombuffer(b"".join(pieces) + bytes(CACHED_BYTES), dtype=np.uint8)
        first, out, width = np.cumsum(sizes) - sizes, [b""] * len(pieces), 8
        while width // 2 < CACHED_BYTES:
            alike = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 8 else 0)))
            for at in range(0, len(alike), LOT):
                lot = alike[at : at + LOT]
                ids, n = self._merge_lot(data[first[lot][:, None] + np.arange(width)], sizes[lot])
                stream = ids[np.arange(width) < n[:, None]].astype("<u4").tobytes()
                for i, (a, b) in zip(lot.tolist(), pairwise([0, *(4 * np.cumsum(n)).tolist()]), strict=True):
                    out[i] = stream[a:b]
            width *= 2
        return out

    def _merge_lot(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece a row and how many they are. rows: the bytes of each, whatever after the first n.

        Each round merges the pair of the lowest rank of each row, the leftmost of several; a row without one leaves.
        """
        place = np.arange(rows.shape[1])
        ids, pairs = self.single[rows], np.full(rows.shape, NONE, dtype=np.int32)
        pairs[:, :-1] = self.of_bytes[rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]]
        pairs[place >= n[:, None] - 1] = NONE
        out, counts, left = np.zeros_like(ids), np.zeros_like(n), np.arange(len(n))
        while True:
            i = pairs.argmin(axis=1)
            low = pairs[np.arange(len(i)), i]
            if (ended := low == NONE).any():
                out[left[ended]], counts[left[ended]] = ids[ended], n[ended]
                left, ids, pairs, n, i, low = (x[~ended] for x in (left, ids, pairs, n, i, low))
            if not len(left):
                return out, counts
            row, later = np.arange(len(i)), place[:-1] > i[:, None]
            for x in (ids, pairs):
                np.copyto(x[:, :-1], x[:, 1:].copy(), where=later)
            pairs[:, -1] = NONE
            ids[row, i] = low
            n = n - 1
            pairs[row, i] = NONE
            h = np.flatnonzero(i + 1 < n)
            pairs[h, i[h]] = self.pair(low[h], ids[h, i[h] + 1])
            h = np.flatnonzero(i)
            pairs[h, i[h] - 1] = self.pair(ids[h, i[h] - 1], low[h])


class _Tokens:
    """The bytes of all tokens in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        size[list(ranks.values())] = list(map(len, ranks))
        self.known, self.size = size > 0, size
        self.first = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of a stream of ids, cut after each of `ends`."""
        if len(ids) and (ids.max() >= len(self.size) or not self.known[ids].all()):
            raise KeyError("an id that is no token's")
        size = self.size[ids]
        after = np.cumsum(size)
        data = self.data[np.arange(size.sum()) + np.repeat(self.first[ids] - after + size, size)].tobytes()
        return [data[a:b] for a, b in pairwise([0, *np.append(0, after)[ends].tolist()])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[_Pieces, _Tokens]:
    ranks = read_ranks(path)
    return _Pieces(ranks), _Tokens(ranks)


def encode_texts(texts: list[str], pieces: _Pieces) -> list[list[bytes]]:
    """For each text, its pieces' ids in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    begins = piece_starts(codes, first[lengths > 0])
    data = "".join(texts).encode()
    if len(data) == len(codes):
        offsets = begins
    else:
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        offsets = (np.cumsum(width) - width)[begins]
    cuts = [*offsets.tolist(), len(data)]
    encoded = pieces.ids_of([data[a:b] for a, b in pairwise(cuts)]) if data else []
    at = np.searchsorted(begins, np.append(first, len(codes))).tolist()
    return [encoded[a:b] for a, b in pairwise(at)]


def _encode(path: str, digests: bool):
    def run(batches):
        pieces, tokens = codec(path)
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                rows = encode_texts(texts_of(part), pieces)
                ids = [b"".join(row) for row in rows]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                back = tokens.decode(np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(n))
                if digests:
                    hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (ids, back)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *hashes], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], type=pa.list_(pa.int32()))
                    ends = [np.cumsum([len(p) // 4 for p in row], dtype=np.int64).astype(np.int32) for row in rows]
                    intact = pa.array([x == t.encode() for x, t in zip(back, texts_of(part), strict=True)])
                    columns = [part.column("doc_id"), pa.array(n), lists, pa.array(ends, type=pa.list_(pa.int32())), intact]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "piece_ends", "intact"])

    return run


def _narrow(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    return documents.select("doc_id", "text")


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, piece_ends, intact of documents(doc_id, text): the ids of each whole text by the rank file
    at `path`, without special tokens, the places in ids where its pieces end, and whether decoding gives the text back.

    Null texts count as empty: no ids. Repeated rows and null ids come out as they come in; other columns are
    ignored. `path` is read on the executors. Memory is bounded by the longest text.
    """
    docs = _narrow(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(path, False), f"doc_id {kind}, n_tokens long, ids array<int>, piece_ends array<int>, intact boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of encoded(doc_id, ids, piece_ends), piece by piece; null ids give no bytes."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = codec(path)[1]
        for batch in batches:
            out = []
            for ids, ends in zip(batch.column("ids").to_pylist(), batch.column("piece_ends").to_pylist(), strict=True):
                out.append(b"".join(tokens.decode(np.array(ids or [], dtype=np.int64), np.array(ends or [], dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, type=pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids", "piece_ends").mapInArrow(run, f"doc_id {kind}, bytes binary")


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text without leaving the worker."""
    docs = _narrow(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(path, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
