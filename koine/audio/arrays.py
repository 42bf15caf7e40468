"""Arrays of samples: runs, robust thresholds, sliding medians."""

from __future__ import annotations

import numpy as np

#: Fixed value: a median deviation times this estimates a standard deviation.
MAD = 1.4826


def runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def run_around(mask: np.ndarray, at: int) -> tuple[int, int]:
    """Start and end of the run that goes through `at`, which counts as true itself."""
    gaps = np.flatnonzero(~mask)
    gaps = gaps[gaps != at]
    i = np.searchsorted(gaps, at)
    return (int(gaps[i - 1]) + 1 if i else 0), (int(gaps[i]) if i < len(gaps) else len(mask))


def short_runs(mask: np.ndarray, most: int) -> np.ndarray:
    """The mask without its runs longer than `most`."""
    out = np.zeros_like(mask)
    for a, b in runs(mask):
        out[a:b] = b - a <= most
    return out


def robust_line(x: np.ndarray, k: float) -> float:
    """The median and k robust deviations."""
    middle = np.median(x)
    return float(middle + k * MAD * (np.median(np.abs(x - middle)) + 1e-20))


def sliding_median(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of an odd number of values around each, zeros beyond the ends; shorter arrays stay as they are."""
    width = int(width) | 1
    if width <= 1 or len(x) < width:
        return x
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2), width), axis=1)
