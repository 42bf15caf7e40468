"""Forced alignment: where each token of a text lies in a recording, by the best path through a matrix of emissions.

A model gives for each frame the log probability of each token and of the blank. The path visits the tokens in order, a
frame or more each, with blanks between them where it likes; between equal neighbours a blank is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from koine.audio.metrics import bytes_of, decode
from koine.scratch import ship

#: Emissions by name: (samples of recordings, their rates) to a matrix of log probabilities for each, frames by tokens;
#: with the tokens' names (the blank is the first) and the seconds of a frame.
EMISSIONS: dict[str, tuple[Callable[[list[np.ndarray], list[int]], list[np.ndarray]], Sequence[str], float]] = {}

#: Bytes of emissions and back pointers that are aligned at a time.
LOT = 64 << 20

#: first and last frame of a token and the mean log probability of its frames.
SPANS = T.ArrayType(T.StructType([T.StructField("token", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def needed(tokens: Sequence[int]) -> int:
    """Frames that a path takes at least: one a token, and a blank between equal neighbours."""
    return len(tokens) + sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))


def align(emissions: Sequence[np.ndarray], texts: Sequence[Sequence[int]], blank: int = 0) -> list[list[tuple[int, int, int, float]] | None]:
    """For each matrix (token, first, last, score) of its tokens on the best path, or None where there is none: too few
    frames, tokens that the matrix doesn't have, or no finite path. An empty text has an empty path.

    All matrices go frame by frame together, padded; among equal scores a path stays rather than moves, and moves by one rather than
    over a blank.
    """
    out: list = [None] * len(texts)
    live = []
    for i, (e, t) in enumerate(zip(emissions, texts, strict=True)):
        if not len(t):
            out[i] = []
        elif np.ndim(e) == 2 and len(e) >= needed(t) and all(0 <= k < e.shape[1] and k != blank for k in t):
            live.append(i)
    if not live:
        return out
    frames, states = max(len(emissions[i]) for i in live), 2 * max(len(texts[i]) for i in live) + 1
    symbol, skip = np.full((len(live), states), blank), np.zeros((len(live), states), dtype=bool)
    wide = max(emissions[i].shape[1] for i in live)
    e = np.full((len(live), frames, wide), -np.inf)
    for row, i in enumerate(live):
        t = np.asarray(texts[i])
        symbol[row, 1 : 2 * len(t) : 2] = t
        skip[row, 3 : 2 * len(t) : 2] = t[1:] != t[:-1]
        some = np.asarray(emissions[i], dtype=np.float64)
        e[row, : len(some), : some.shape[1]] = np.where(np.isnan(some), -np.inf, some)
    rows = np.arange(len(live))[:, None]
    best = np.full((len(live), states), -np.inf)
    best[:, :2] = e[rows, 0, symbol[:, :2]]
    back = np.zeros((frames, len(live), states), dtype=np.int8)
    ends = [len(emissions[i]) for i in live]
    final = best.copy()
    for f in range(1, frames):
        one, two = np.full_like(best, -np.inf), np.full_like(best, -np.inf)
        one[:, 1:] = best[:, :-1]
        two[:, 2:] = np.where(skip[:, 2:], best[:, :-2], -np.inf)
        step = np.zeros_like(back[f])
        top = best.copy()
        for size, other in ((1, one), (2, two)):
            better = other > top
            top[better], step[better] = other[better], size
        back[f] = step
        best = top + e[rows, f, symbol]
        done = [row for row, n in enumerate(ends) if n == f + 1]
        final[done] = best[done]
    for row, i in enumerate(live):
        last = 2 * len(texts[i])
        state = last if final[row, last] > final[row, last - 1] else last - 1
        if not np.isfinite(final[row, state]):
            continue
        path = np.empty(ends[row], dtype=np.int64)
        for f in range(ends[row] - 1, -1, -1):
            path[f] = state
            state -= int(back[f, row, state])
        score = e[row, np.arange(ends[row]), symbol[row, path]]
        spans = []
        for k, token in enumerate(texts[i]):
            at = np.nonzero(path == 2 * k + 1)[0]
            spans.append((int(token), int(at[0]), int(at[-1]), float(score[at].mean())))
        out[i] = spans
    return out


def lots(sizes: Sequence[tuple[int, int, int]], most: int = LOT) -> Iterator[list[int]]:
    """Indices of (frames, tokens, symbols) whose padded matrices and back pointers take at most so many bytes together; a
    larger one comes alone."""
    some: list[int] = []
    top = (0, 0, 0)
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        grown = tuple(map(max, top, sizes[i]))
        if some and (len(some) + 1) * grown[0] * (8 * grown[2] + 2 * grown[1] + 1) > most:
            yield some
            some, grown = [], sizes[i]
        some.append(i)
        top = grown
    if some:
        yield some


def align_lots(emissions: Sequence[np.ndarray], texts: Sequence[Sequence[int]], blank: int = 0, most: int = LOT) -> list:
    """align() in lots bounded by bytes."""
    out: list = [None] * len(texts)
    sizes = [(len(e), len(t), e.shape[1] if np.ndim(e) == 2 else 0) for e, t in zip(emissions, texts, strict=True)]
    for lot in lots(sizes, most):
        for i, spans in zip(lot, align([emissions[i] for i in lot], [texts[i] for i in lot], blank), strict=True):
            out[i] = spans
    return out


def alignment(emissions: Column, tokens: Column, blank: int = 0) -> Column:
    """Spans of the tokens (ids) in a matrix of emissions (a list of frames); null where either is null, a token or frame is missing, or there is no path."""

    @F.pandas_udf(SPANS)
    def udf(matrices: pd.Series, texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i in range(len(texts)) if matrices.iloc[i] is not None and texts.iloc[i] is not None and not pd.isna(texts.iloc[i]).any()]
        made = [_matrix(matrices.iloc[i]) for i in at]
        for i, spans in zip(at, align_lots(made, [[int(k) for k in texts.iloc[i]] for i in at], blank), strict=True):
            out[i] = None if spans is None else [dict(zip(("token", "first", "last", "score"), s, strict=True)) for s in spans]
        return pd.Series(out, dtype="object")

    return udf(emissions, tokens)


def _matrix(frames) -> np.ndarray:
    """Frames of a list; nothing where one is missing or of another length."""
    if any(f is None for f in frames) or len({len(f) for f in frames}) != 1:
        return np.empty((0, 0))
    return np.stack([np.asarray(f, dtype=np.float64) for f in frames])


HEARD = T.ArrayType(
    T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("score", T.DoubleType())])
)


def aligned(df: DataFrame, recording: str, tokens: str, backend: str, name: str = "aligned") -> DataFrame:
    """df with the spans of its tokens (names) in its recordings (contents or URIs), in seconds, by a registered model of
    emissions; null where a recording or tokens are missing, can't be read or have no path. Tokens that the model doesn't
    know are left out of the path. Recordings are read and aligned in lots bounded by bytes."""
    if backend not in EMISSIONS:
        raise ValueError(f"no emissions named {backend!r} are registered")
    ship(df.sparkSession)
    (model, names, seconds), kind = EMISSIONS[backend], to_arrow_type(HEARD)
    ids = {n: i for i, n in enumerate(names) if i}

    def lot_of(rows: list[tuple]) -> list:
        """rows: (samples, rate, tokens), samples None where unreadable."""
        out: list = [None] * len(rows)
        at = [i for i, (y, _, t) in enumerate(rows) if y is not None and t is not None]
        if at:
            known = [[n for n in rows[i][2] if n in ids] for i in at]
            made = model([rows[i][0] for i in at], [rows[i][1] for i in at])
            found = align_lots(list(made), [[ids[n] for n in t] for t in known])
            for i, spans in zip(at, found, strict=True):
                out[i] = spans and [{"token": names[k], "start": a * seconds, "end": (b + 1) * seconds, "score": s} for k, a, b, s in spans] if spans is not None else None
        return out

    def read(content):
        try:
            return decode(bytes_of(content)) if content is not None else (None, 0)
        except Exception:  # a recording that can't be read has no alignment
            return None, 0

    def through(batches):
        for b in batches:
            contents, texts, some, size, at = b.column(recording), b.column(tokens).to_pylist(), [], 0, 0
            for i in range(b.num_rows):
                y, rate = read(contents[i].as_py())
                some.append((y, rate, texts[i]))
                size += 0 if y is None else y.nbytes
                if size >= LOT or i + 1 == b.num_rows:
                    yield pa.record_batch([*b.slice(at, len(some)).columns, pa.array(lot_of(some), kind)], names=[*b.schema.names, name])
                    at, some, size = i + 1, [], 0

    return df.mapInArrow(through, T.StructType([*df.schema.fields, T.StructField(name, HEARD)]))


def best_path(emissions: Column, blank: int = 0) -> Column:
    """The token of most probability in each frame, repeats once, without blanks: what a model hears by itself."""
    top = F.transform(emissions, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    before = F.concat(F.array(F.lit(-1)), top)
    fresh = F.filter(F.transform(top, lambda x, i: F.when(x != F.get(before, i), x)), lambda x: x.isNotNull() & (x != blank))
    return F.when(emissions.isNotNull(), fresh)
