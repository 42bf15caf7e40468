"""Spectral steps: noise profiles, lip noise, reverberation. Values of the rules are parameters with fixed defaults."""

from __future__ import annotations

import numpy as np

from koine.audio.arrays import runs, short_runs, sliding_median
from koine.audio.spectra import istft, stft


def _odd(width: int, least: int, most: int, n: int) -> int:
    """An odd width within bounds, no longer than an array of n."""
    return max(3, min(max(least, min(most, int(width) | 1)), n - 1 + n % 2))


def spectral_subtract(
    y: np.ndarray, rate: int, size: int = 1024, hop: int = 256, amount: float = 1.0, floor: float = 0.05, lead_ms: float = 120.0, trail_ms: float = 80.0, quiet_percentile: float = 8.0,
    most_frames: int = 64, tail_mix: float = 0.0, tail_ms: float = 400.0, tail_percentile: float = 35.0,
) -> np.ndarray:
    """Take a noise profile out of the power of each frame; at least `floor` of a magnitude stays.

    The profile is the mean of the first most_frames of the frames in the lead, in the trail or among the quietest. With tail_mix, it
    is raised to that share of the mean of the tail's quieter frames, where a room still sounds.
    """
    if len(y) < hop + 16:
        return y.astype(np.float32)
    spectra = stft(y.astype(np.float64), size, hop)
    mag = np.abs(spectra)
    n, place = len(mag), np.arange(len(mag))
    if n < 2:
        return y.astype(np.float32)
    frames = lambda ms: int(round(ms * rate / 1000 / hop))
    level = np.sqrt((mag**2).mean(axis=1) + 1e-20)
    noisy = np.flatnonzero((place < frames(lead_ms)) | (place >= n - frames(trail_ms)) | (level <= np.percentile(level, quiet_percentile)))
    profile = mag[noisy[: max(1, most_frames)]].mean(axis=0) + 1e-10
    if tail_mix > 0 and tail_ms > 0:
        tail = slice(n - max(2, min(frames(tail_ms), n)), n)
        soft = level[tail] <= np.percentile(level[tail], tail_percentile)
        profile = np.maximum(profile, tail_mix * (mag[tail][soft].mean(axis=0) + 1e-10))
    left = np.sqrt(np.maximum(mag**2 - amount * profile**2, 0))
    return istft(spectra * (np.maximum(left, floor * mag) / np.maximum(mag, 1e-12)), size, hop, len(y)).astype(np.float32)


def lip_noise_suppress(
    y: np.ndarray, rate: int, size: int = 2048, hop: int = 512, low: float = 1400.0, high: float | None = None, ratio: float = 7.0, most_frames: int = 6, keep: float = 0.52, around: int = 11, smooth: int = 3,
    least_share: float = 0.22, share_ratio: float = 1.35,
) -> np.ndarray:
    """Attenuate a band where short bursts stand out: frames with `ratio` times the sliding median's power, whose share in
    the band is large, and larger than around, for at most most_frames in a row."""
    if len(y) < hop + 16:
        return y.astype(np.float32)
    spectra = stft(y.astype(np.float64), size, hop)
    if len(spectra) < 4:
        return y.astype(np.float32)
    power, bins = np.abs(spectra) ** 2, np.fft.rfftfreq(size, 1 / rate)
    a = min(int(np.searchsorted(bins, low)), len(bins) - 1)
    band = slice(a, max(a + 1, int(np.searchsorted(bins, high or rate / 2, side="right"))))
    width = _odd(around, 3, 65, len(spectra))
    whole = power.mean(axis=1) + 1e-20
    share = (power[:, band].mean(axis=1) + 1e-20) / whole
    odd = (whole >= ratio * (sliding_median(whole, width) + 1e-20)) & (share >= np.maximum(least_share, share_ratio * (sliding_median(share, width) + 1e-20)))
    burst = short_runs(odd, int(np.clip(most_frames, 1, 64)))
    if not burst.any():
        return y.astype(np.float32)
    k = int(np.clip(int(smooth) | 1, 1, 31))
    weight = np.clip(np.convolve(burst.astype(np.float64), np.ones(k) / k, "same"), 0, 1)
    spectra[:, band] *= (1 - weight * (1 - np.clip(keep, 0.08, 0.98)))[:, None]
    return istft(spectra, size, hop, len(y)).astype(np.float32)


def centred_spans(spans: np.ndarray, middle: np.ndarray, widest: int, n: int) -> np.ndarray:
    """Spans as they are where they are no longer than `widest`; else so long, around their middle, within [0, n)."""
    start = np.maximum(0, middle - widest // 2)
    end = np.minimum(n, start + widest)
    cut = np.stack([np.maximum(0, end - widest), end], axis=1)
    return np.where((spans[:, 1] - spans[:, 0] > widest)[:, None], cut, spans)


def lip_noise_spans(
    y: np.ndarray, rate: int, frame_ms: float = 2.5, hop_ms: float = 0.65, around_ms: float = 9.0, level_ratio: float = 5.5, crossing_ratio: float = 2.6, crest: float = 6.0, flux_ratio: float | None = 3.5,
    most_ms: float = 24.0, gap_ms: float = 2.5, pad_ms: float = 1.8, widest_ms: float = 28.0, most: int = 96,
) -> list[tuple[int, int]]:
    """Places of short transients: frames louder than around, peaked, and with more zero crossings or more spectral flux than
    around; flux_ratio None or 0 leaves the flux out. The `most` with the highest peaks count."""
    frame, hop, n = max(16, round(frame_ms * rate / 1000)), max(4, round(hop_ms * rate / 1000)), len(y)
    if n < max(32, frame + hop) or rate < 4000:
        return []
    x = np.lib.stride_tricks.sliding_window_view(y.astype(np.float64), frame)[::hop]
    if len(x) < 5:
        return []
    width = _odd(round(around_ms / hop_ms), 3, 201, len(x))
    beyond = lambda v, k: v / (sliding_median(v, width) + 1e-20) >= k
    level = np.sqrt((x * x).mean(axis=1) + 1e-20)
    crossings = (np.diff(x >= 0, axis=1) != 0).mean(axis=1)
    rises = np.diff(np.abs(np.fft.rfft(x[:, -min(256 if frame <= 256 else frame - frame % 2, frame) :], axis=1)), axis=0)
    flux = np.append(0.0, np.maximum(rises, 0).sum(axis=1))
    odd = beyond(level, level_ratio) & (np.abs(x).max(axis=1) / level >= crest) & (beyond(crossings, crossing_ratio) | (beyond(flux, flux_ratio) if flux_ratio and flux_ratio > 0 else False))
    found = runs(short_runs(odd, max(1, round(most_ms / hop_ms)))) * hop
    if not len(found):
        return []
    samples = lambda ms: round(ms * rate / 1000)
    touched = np.zeros(n + 1, dtype=bool)
    for a, b in found + [0, frame - hop]:
        touched[a : min(n, b)] = True
    gaps = runs(~touched[:n])
    for a, b in gaps[(gaps[:, 1] - gaps[:, 0] <= samples(gap_ms)) & (gaps[:, 0] > 0) & (gaps[:, 1] < n)] if len(gaps) else []:
        touched[a:b] = True
    spans = runs(touched[:n])
    peaks = np.array([a + int(np.abs(y[a:b]).argmax()) for a, b in spans])
    spans = centred_spans(spans, peaks, max(frame, samples(most_ms)), n)
    spans = np.clip(spans + [-samples(pad_ms), samples(pad_ms)], 0, n)
    spans = centred_spans(spans, spans.sum(axis=1) // 2, max(frame, samples(widest_ms)), n)
    covered = np.zeros(n, dtype=bool)
    for a, b in spans:
        covered[a:b] = True
    spans = runs(covered)
    if 0 < most < len(spans):
        spans = np.sort(spans[np.argsort([-np.abs(y[a:b]).max() for a, b in spans], kind="stable")[:most]], axis=0)
    return [(int(a), int(b)) for a, b in spans if b - a < n]


def wpe(y: np.ndarray, rate: int, size: int = 512, hop: int = 128, taps: int = 10, delay: int = 3, iterations: int = 3, context: int = 1) -> np.ndarray:
    """Less late reverberation: of each frequency, what its frames `delay` and more back predict is taken out.

    Weighted prediction error: frames count by the inverse of the power that the last iteration leaves them, averaged over `context`
    frames on either side; the normal equations of all frequencies are solved as one batch. Short recordings stay.
    """
    if len(y) < size + 4 * hop:
        return y.astype(np.float32)
    observed = stft(y.astype(np.float64), size, hop).T
    bins, n = observed.shape
    if n < delay + taps + 3:
        return y.astype(np.float32)
    past = np.zeros((bins, taps, n), dtype=observed.dtype)
    for k in range(taps):
        past[:, k, delay + k :] = observed[:, : n - delay - k]
    left = observed
    for _ in range(iterations):
        power = np.abs(left) ** 2
        if context:
            kernel = np.ones(2 * context + 1)
            power = np.apply_along_axis(lambda p: np.convolve(p, kernel, "same") / np.convolve(np.ones(n), kernel, "same"), 1, power)
        weighted = past / np.maximum(power, 1e-10 * max(power.max(), 1e-12))[:, None, :]
        normal = weighted @ past.conj().transpose(0, 2, 1)
        load = 1e-8 * np.trace(normal, axis1=1, axis2=2).real / taps + 1e-12
        normal = normal + load[:, None, None] * np.eye(taps)
        filters = np.linalg.solve(normal, weighted @ observed.conj()[:, :, None])
        left = observed - (filters.conj().transpose(0, 2, 1) @ past)[:, 0]
    return istft(left.T, size, hop, len(y)).astype(np.float32)
