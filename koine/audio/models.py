"""Runners of steps that need a model: long recordings in overlapping chunks, many recordings in padded batches.

A model takes samples as (batch, time) with each row's length, and gives back as many. What is held at once is bounded by
bytes, not by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Takes (samples (b, n) as float32, lengths (b,), rate, parameters), gives samples (b, n).
BatchModel = Callable[[np.ndarray, np.ndarray, int, dict], np.ndarray]
#: Registered models by the name of their step.
BATCHED: dict[str, BatchModel] = {}


def chunks_of(n: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `most` samples over n, each `overlap` into the one before."""
    if n <= most:
        return [(0, n)]
    step = max(1, most - overlap)
    return [(a, min(n, a + most)) for a in range(0, n - overlap, step)]


def joined(parts: list[np.ndarray], spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Chunks put together, a linear cross-fade where two of them overlap."""
    out, weight = np.zeros(n, dtype=np.float64), np.zeros(n, dtype=np.float64)
    for i, ((a, b), x) in enumerate(zip(spans, parts, strict=True)):
        w = np.ones(b - a)
        if i and (k := spans[i - 1][1] - a) > 0:
            w[:k] = np.arange(1, k + 1) / (k + 1)
        if i + 1 < len(spans) and (k := b - spans[i + 1][0]) > 0:
            w[b - a - k :] = np.minimum(w[b - a - k :], np.arange(k, 0, -1) / (k + 1))
        out[a:b] += x[: b - a] * w
        weight[a:b] += w
    return (out / np.maximum(weight, 1e-12)).astype(np.float32)


def batches(lengths: list[int], most_bytes: int) -> list[list[int]]:
    """Indices in groups of like lengths; a group's padded samples take at most so many bytes, a longer one comes alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and 4 * lengths[i] * (len(out[-1]) + 1) <= most_bytes:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def run_model(model: BatchModel, samples: list[np.ndarray], rate: int, p: dict, most_bytes: int = 64 << 20, chunk_sec: float = 96.0, overlap_sec: float = 1.0) -> list[np.ndarray]:
    """Each recording through the model: cut into chunks, those in padded batches, put together again."""
    most, overlap = max(2, int(chunk_sec * rate)), int(overlap_sec * rate)
    spans = [chunks_of(len(y), most, min(overlap, most // 2)) for y in samples]
    pieces = [(i, k) for i, own in enumerate(spans) for k in range(len(own)) if len(samples[i])]
    sizes = [spans[i][k][1] - spans[i][k][0] for i, k in pieces]
    done: dict[tuple[int, int], np.ndarray] = {}
    for group in batches(sizes, most_bytes):
        lengths = np.array([sizes[g] for g in group])
        x = np.zeros((len(group), int(lengths.max())), dtype=np.float32)
        for row, g in enumerate(group):
            i, k = pieces[g]
            x[row, : lengths[row]] = samples[i][slice(*spans[i][k])]
        y = model(x, lengths, rate, p)
        for row, g in enumerate(group):
            done[pieces[g]] = np.asarray(y[row, : lengths[row]], dtype=np.float32)
    return [joined([done[i, k] for k in range(len(own))], own, len(y)) if len(y) else y for i, (own, y) in enumerate(zip(spans, samples, strict=True))]


def gathered(items: Iterable[tuple], most_bytes: int) -> Iterator[list[tuple]]:
    """(key, samples, ...) in lots of about so many bytes of samples, in their order."""
    lot, held = [], 0
    for item in items:
        lot.append(item)
        held += item[1].nbytes
        if held >= most_bytes:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot
