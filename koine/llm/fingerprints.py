"""Document fingerprints from prefix polynomial hashes.

A prefix array holds the polynomial of every prefix of a text modulo two primes; two subtractions and a shift give
the hash of any span, and a binary search over spans the longest common extension of two places.

A fingerprint keeps the prefix array at places that the text itself chooses: those where the hash of the next few code
points ends in enough zero bits, so a passage has the same places wherever it stands. Every place has a level, the
number of these bits; a text keeps the lowest level with at most KEPT places, and two texts meet at the higher of their
levels. Where windows repeat, as in a word said over and over, places are told from the start of that run. Their likeness is the share of the longer text in passages that both have: from a place where both have the
same span, the longest common extension is found by binary search over the kept prefixes, and the longest is taken.
So edits cost the spans they touch, wherever they are, and a passage that moves is found.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.llm.common import ship, text_slices, texts_of

#: Moduli and bases.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points that choose a place, places kept (until levels end), highest level, bits of the step from place to place.
WINDOW, KEPT, TOP, STEP_BITS = 8, 64, 15, 29
#: Windows in a row that repeat at a period of at most PERIOD, at least: such a run has places of its own.
RUN, PERIOD = 16, 256
#: Code points of a common passage that count, at least; a quarter of a shorter text.
PASSAGE = 12


class _Powers:
    """Powers of the bases and of their inverses, grown on demand to the longest text."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def reach(self, n: int) -> None:
        if n <= self.n:
            return
        size = max(n, 2 * self.n, 1 << 12)
        self.up = [_powers(b, p, size) for b, p in zip(BASES, PRIMES, strict=True)]
        self.down = [_powers(pow(b, -1, p), p, size) for b, p in zip(BASES, PRIMES, strict=True)]
        self.n = size


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out, have = np.ones(n, dtype=np.uint64), 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += step
    return out


_POWERS = _Powers()


class PrefixHashes:
    """Prefix arrays of one text, over its code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        if self.n >= 1 << STEP_BITS:
            raise ValueError(f"a text has {self.n} code points; fingerprints hold less than 2**{STEP_BITS}")
        _POWERS.reach(self.n + 1)
        self.prefix, self.mark = [], None
        for up, p in zip(_POWERS.up, PRIMES, strict=True):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes * up[: self.n] % np.uint64(p), out=sums[1:])
            self.prefix.append(sums % np.uint64(p))

    def span(self, k: int, start, stop) -> np.ndarray:
        """Hashes of spans [start, stop) modulo the k-th prime."""
        h, p = self.prefix[k], np.uint64(PRIMES[k])
        return (h[stop] + p - h[start]) % p * _POWERS.down[k][start] % p

    def spans(self, start, stop) -> list[np.ndarray]:
        """Hashes of spans [start, stop), by prime."""
        start, stop = np.asarray(start), np.asarray(stop)
        return [self.span(k, start, stop) for k in range(len(PRIMES))]

    @cached_property
    def windows(self) -> np.ndarray:
        """The hash of the next span of each place."""
        full = max(0, self.n - WINDOW + 1)  # places with a whole window
        return np.concatenate([self.span(0, slice(0, full), slice(WINDOW, WINDOW + full)), _windows(self.n, self.span, full, self.n)])

    @cached_property
    def chosen(self) -> np.ndarray:
        """The level of each place by its window alone."""
        return _levels_of(self.windows)

    @cached_property
    def levels(self) -> np.ndarray:
        """The level of each place."""
        return _with_runs(self.chosen, self.windows)

    def equal(self, a: int, other: PrefixHashes, b: int, length: int) -> bool:
        """Whether the spans of this length at a here and at b there agree."""
        return all(int(x) == int(y) for x, y in zip(self.spans(a, a + length), other.spans(b, b + length), strict=True))

    def common_extension(self, a: int, other: PrefixHashes, b: int) -> int:
        """Length of the longest common extension of place a here and place b there."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, other, b, mid) else (low, mid - 1)
        return low


def _levels_of(hashes: np.ndarray) -> np.ndarray:
    """Zero bits at the end of each hash, after mixing."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TOP)
    low = (x & (~x + np.uint64(1))).astype(np.float64)
    return np.where(x == 0, TOP, np.frexp(low)[1] - 1).astype(np.int64)


def _windows(n: int, span, first: int, last: int) -> np.ndarray:
    """The hashes of the next spans of places from first to last of a text of n code points."""
    start = np.arange(first, last)
    return span(0, start, np.minimum(start + WINDOW, n))


def _periods(windows: np.ndarray) -> list[int]:
    """Periods of at most PERIOD at which RUN windows in a row, or more, repeat; of those that divide one another the smallest.

    Of RUN windows in a row two are on a grid of RUN / 2: a period at which these two repeat is looked at, no others.
    """
    grid = np.arange(0, len(windows), RUN // 2)
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(PERIOD, 1 << 63, dtype=np.uint64), windows]), PERIOD)
    out: set[int] = set()
    for at in range(0, len(grid), 2048):
        own = grid[at : at + 2049]
        hits = before[own] == windows[own][:, None]
        both = hits[1:] & hits[:-1]
        both = both[both.any(axis=1)][:, ::-1]  # column p - 1 is period p
        for p in (np.flatnonzero(both.any(axis=0)) + 1).tolist():
            if p not in out:
                smaller = [q - 1 for q in range(1, p // 2 + 1) if p % q == 0]
                if (both[:, p - 1] & ~both[:, smaller].any(axis=1)).any():
                    out.add(p)
    return sorted(out)


def _with_runs(levels: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Levels, but in runs of repeating windows, which all have one of few levels, the zero bits of the distance from the
    run's start: as many places of each level as elsewhere, and the same ones wherever the run stands."""
    if len(windows) <= RUN or not (periods := _periods(windows)):
        return levels
    inside = np.zeros(len(windows), dtype=bool)
    for p in periods:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (windows[p:] == windows[:-p]).astype(np.int8), [0]]))).reshape(-1, 2) + p
        for a, b in edges[edges[:, 1] - edges[:, 0] >= RUN]:
            inside[a:b] = True
    out = levels.copy()
    for a, b in np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2):
        far = np.arange(1, b - a + 1)
        out[a:b] = np.minimum(TOP, np.frexp((far & -far).astype(np.float64))[1] - 1)
    return out


def _string(n: int, whole: list[int], levels: np.ndarray, span) -> str:
    """Length, hash of the whole, level, and for each kept place its prefix hash, its level and the step to it."""
    counts = np.bincount(levels[1:], minlength=TOP + 1)  # the text's start is no place
    above = np.cumsum(counts[::-1])[::-1]  # places of each level or a higher one
    level = int(np.argmax(above <= KEPT)) if above[TOP] <= KEPT else TOP
    at = np.flatnonzero(levels[1:] >= level) + 1
    step = at.copy()
    step[1:] -= at[:-1]
    entry = span(0, 0 * at, at) << np.uint64(33) | (levels[at] << STEP_BITS | step).astype(np.uint64)
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}.{level:x}.{entry.astype('>u8').tobytes().hex()}"


def fingerprint(own: PrefixHashes) -> str:
    """The fingerprint of a text, of at most 2**29 code points, from its prefix arrays."""
    return _string(own.n, [int(h[own.n]) for h in own.prefix], own.levels, own.span)


def joined_fingerprint(a: PrefixHashes, head: int, b: PrefixHashes, more: int) -> str:
    """The fingerprint of the first `head` code points of a followed by the first `more` of b, from their arrays. Places
    whose next span lies in one of the two have its level; only those before the joint and the end are made anew."""
    n = head + more
    _POWERS.reach(n + 1)

    def span(k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        left = a.span(k, np.minimum(start, head), np.minimum(stop, head))
        right = b.span(k, np.maximum(start - head, 0), np.maximum(stop - head, 0))
        by = np.maximum(np.minimum(stop, head) - np.minimum(start, head), 0)
        return (left + right * _POWERS.up[k][by]) % np.uint64(PRIMES[k])

    x, y = max(0, head - WINDOW + 1), max(0, more - WINDOW + 1)
    joint, end = _windows(n, span, x, head), _windows(n, span, head + y, n)
    levels = np.concatenate([a.chosen[:x], _levels_of(joint), b.chosen[:y], _levels_of(end)])
    levels = _with_runs(levels, np.concatenate([a.windows[:x], joint, b.windows[:y], end]))
    return _string(n, [int(span(k, 0, n)) for k in range(len(PRIMES))], levels, span)


@dataclass
class Kept:
    """A prefix array at the places that a fingerprint keeps, from 0 to the text's end, at one level."""

    at: list[int]
    prefix: list[int]

    def length(self, i: int, k: int) -> int:
        return self.at[k] - self.at[i]

    def same(self, i: int, k: int, other: Kept, j: int, m: int) -> bool:
        """Whether the spans from place i to k here and j to m there agree."""
        p, up = PRIMES[0], _POWERS.up[0]
        if self.length(i, k) != other.length(j, m):
            return False
        a, b = self.prefix[k] - self.prefix[i], other.prefix[m] - other.prefix[j]
        shift = self.at[i] - other.at[j]
        return (b * int(up[shift]) - a) % p == 0 if shift >= 0 else (a * int(up[-shift]) - b) % p == 0

    def common_extension(self, i: int, other: Kept, j: int) -> int:
        """How many spans from place i here and place j there agree: a binary search as far as the steps are the same."""
        low, here, there = 0, self.at[i], other.at[j]
        high = next((k for k, (x, y) in enumerate(zip(self.at[i + 1 :], other.at[j + 1 :])) if x - here != y - there), min(len(self.at) - i, len(other.at) - j) - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, i + mid, other, j, j + mid) else (low, mid - 1)
        return low

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """Length and hash of each span between neighbouring places."""
        at, p = np.array(self.at), np.uint64(PRIMES[0])
        prefix = np.array(self.prefix, dtype=np.uint64)
        hashes = (prefix[1:] + p - prefix[:-1]) % p * _POWERS.down[0][at[:-1]] % p
        return list(zip((at[1:] - at[:-1]).tolist(), hashes.tolist(), strict=True))


@lru_cache(maxsize=16)
def kept_places(mark: str, level: int) -> Kept:
    n, whole, _, hexed = mark.split(".")
    entries = np.frombuffer(bytes.fromhex(hexed), dtype=">u8").astype(np.uint64)
    at = np.cumsum((entries & np.uint64((1 << STEP_BITS) - 1)).astype(np.int64))
    high = (entries >> np.uint64(STEP_BITS) & np.uint64(15)) >= np.uint64(level)
    end = int(n, 16)
    return Kept([0, *at[high].tolist(), end], [0, *(entries[high] >> np.uint64(33)).tolist(), int(whole[:8], 16)])


def likeness(one: str, two: str) -> float:
    """The share of the longer text in passages that both fingerprints show, each passage once; 1 for equal texts, 0 for
    an empty one and another. Passages are taken from left to right, always the longest."""
    if one == two:
        return 1.0
    one, two = sorted((one, two))
    (n, _, level, _), (m, _, other, _) = one.split("."), two.split(".")
    n, m, level = int(n, 16), int(m, 16), max(int(level, 16), int(other, 16))
    if not n or not m:
        return 0.0
    _POWERS.reach(max(n, m) + 1)
    a, b = kept_places(one, level), kept_places(two, level)
    places: dict[tuple[int, int], list[int]] = {span: [] for span in set(a.spans) & set(b.spans)}
    if not places:
        return 0.0
    for j, span in enumerate(b.spans):
        if span in places:
            places[span].append(j)
    free, spans, least = [True] * len(b.at), a.spans, min(PASSAGE, -(-min(n, m) // 4))
    i = same = 0
    while i < len(spans):
        best = (0, 0)
        for j in places.get(spans[i], ()):
            if free[j]:
                k = a.common_extension(i, b, j)
                best = max(best, (next((x for x in range(k) if not free[j + x]), k), -j))
        k, j = best[0], -best[1]
        if k and a.length(i, i + k) >= least:
            free[j : j + k] = [False] * k
            same += a.length(i, i + k)
            i += k
        else:
            i += 1
    return same / max(n, m)


LEAST = -(1 << 63)


def _ids(batch) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(batch.column("doc_id"), LEAST), dtype=np.int64)


def fingerprint_documents(documents: DataFrame, lots: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for documents(doc_id, text).

    The next document is the one with the next smaller doc_id, after the smallest the largest; null ids are the
    smallest, repeated ids follow one another by text. A single document is its own next. Null texts count as empty.
    Two empty texts are alike (1), an empty and another are not (0). Other columns are ignored. Empty table: no rows.

    Documents are dealt to ranges of ids by quantiles; each range also gets the first document of the one that
    follows, and is walked in order with two texts in memory.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lots = lots or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    probabilities, ids = [i / lots for i in range(1, lots)], F.coalesce("doc_id", F.lit(LEAST))
    cuts = docs.agg(F.percentile_approx(ids, probabilities, 10 * lots)).first()[0] if probabilities else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def lot_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids, side="right").astype(np.int32)

    def firsts(batches):
        for batch in batches:
            if batch.num_rows:
                ids = _ids(batch)
                lot = lot_of(ids)
                found = np.unique(lot)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([ids[lot == x].max() for x in found], type=pa.int64())], ["lot", "first"])

    first = {r.lot: r.first for r in docs.select("doc_id").mapInArrow(firsts, "lot int, first long").groupBy("lot").agg(F.max("first").alias("first")).collect()}
    order = sorted(first)  # at most `lots` entries
    to = {first[x]: order[(i + 1) % len(order)] for i, x in enumerate(order)}  # the first of a lot follows the last of the lot above

    def deal(batches):
        heads = np.array(sorted(to), dtype=np.int64)
        for batch in batches:
            ids = _ids(batch)
            yield _dealt(batch, lot_of(ids), False)
            guests = np.flatnonzero(np.isin(ids, heads))
            if len(guests):
                yield _dealt(batch.take(pa.array(guests)), np.array([to[x] for x in ids[guests].tolist()], dtype=np.int32), True)

    def walk(batches):
        lot, held, done = None, None, True
        for batch in batches:
            for part in text_slices(batch):
                rows = zip(part.column("lot").to_pylist(), part.column("guest").to_pylist(), part.column("doc_id").to_pylist(), texts_of(part), strict=True)
                out = []
                for now, guest, doc_id, text in rows:
                    if now != lot:
                        lot, held, done = now, None, False
                    if done:
                        continue
                    own = PrefixHashes(text)
                    own.mark = fingerprint(own)
                    if held:
                        out.append(_compared(*held, text, own))
                    held, done = (doc_id, text, own), guest
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_schema)

    dealt = docs.mapInArrow(deal, "lot int, guest boolean, doc_id long, text string").repartition("lot")
    dealt = dealt.sortWithinPartitions("lot", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_schema = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _dealt(batch, lot: np.ndarray, guest: bool):
    return pa.RecordBatch.from_arrays(
        [pa.array(lot), pa.array(np.full(batch.num_rows, guest)), batch.column("doc_id"), batch.column("text")], ["lot", "guest", "doc_id", "text"]
    )


def _compared(doc_id, text: str, own: PrefixHashes, next_text: str, following: PrefixHashes) -> dict:
    half = own.n // 2
    head, more = own.n - half, min(half, following.n)
    edited = joined_fingerprint(own, head, following, more)
    mark, other = own.mark, following.mark
    return {
        "doc_id": doc_id,
        "n_chars": own.n,
        "edited_sha256": hashlib.sha256((text[:head] + next_text[:more]).encode()).hexdigest(),
        "fingerprint": mark,
        "edited_fingerprint": edited,
        "near_edited": likeness(mark, edited),
        "near_next": likeness(mark, other),
    }
