"""Clicks of buttons at the edges of a recording: three detectors, a voice-activity start, and what takes precedence.

A click is a jump between samples that stands out of its surroundings (MAD), is short, and carries more energy than what lies
on the side away from the voice. Before the voice it is searched for up to the first sustained voice; after it in the last
stretch. Of several the one nearest to the end of the stretch counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from koine.audio.arrays import MAD, robust_line, run_around, runs, sliding_median

#: Shares and floors of the rules.
WIDTH_SHARES, CUT_SHARES = (0.22, 0.35), (0.2, 0.45)
SILENT_LEAD, SILENT_TRAIL = 0.45, 0.42
LEAST_WIDTH = 32


@dataclass(frozen=True)
class EdgeClicks:
    """Samples left, milliseconds taken from either side, and what was found there: high, none or why not."""

    y: np.ndarray
    leading_ms: float = 0.0
    trailing_ms: float = 0.0
    leading: str = "none"
    trailing: str = "none"


def frame_levels(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Root mean squares of whole frames, a hop apart."""
    if len(x) < frame:
        return np.zeros(0)
    squares = np.concatenate([[0.0], np.cumsum(np.asarray(x, dtype=np.float64) ** 2)])
    starts = np.arange(0, len(x) - frame + 1, hop)
    return np.sqrt(np.maximum(squares[starts + frame] - squares[starts], 0) / frame + 1e-18)


def voice_start(x: np.ndarray, rate: int, k: float, frame_ms: float = 20.0, hop_ms: float = 5.0, least_ms: float = 50.0) -> int:
    """The sample where voice first lasts; all of x where it never does."""
    frame, hop = max(128, round(rate * frame_ms / 1000)), max(32, round(rate * hop_ms / 1000))
    levels = frame_levels(x, frame, hop) if len(x) >= 32 else np.zeros(0)
    if not len(levels):
        return len(x)
    middle = np.median(levels)
    deviation = max(np.median(np.abs(levels - middle)) + 1e-20, middle * 0.11 + 1e-12, levels.std() * 0.25 + 1e-12)
    least = max(2, round(least_ms / max(1000 * frame / rate * 0.35, 1e-6)))
    long = [a for a, b in runs(levels >= middle + k * MAD * deviation) if b - a >= least]
    return int(min(len(x), long[0] * hop)) if long else len(x)


def _spikes(x: np.ndarray, centres: np.ndarray, window: int, near: int, ratio: float, side: str) -> np.ndarray:
    """Which centres have so much more energy in a window from there on than the median window of the side's neighbourhood. Where there is no
    room for a neighbourhood any energy will do; where x is too short for three, all pass."""
    if len(x) < window + 2 * near:
        return np.ones(len(centres), dtype=bool)
    energy = np.convolve(x * x, np.ones(window), "valid")
    floor = max(np.percentile(energy, 55) * 0.08 + 1e-20, 1e-20)
    out = []
    for c in np.clip(centres, 0, len(x) - window):
        lo, hi = (max(0, c - near - window), max(0, c - window)) if side == "leading" else (min(len(energy), c + window), min(len(energy), c + near + window))
        here = energy[min(c, len(energy) - 1)]
        out.append(here >= ratio * max(np.median(energy[lo:hi]), floor) if hi > lo else here > 1e-12)
    return np.array(out, dtype=bool)


def find_click(x: np.ndarray, rate: int, side: str, k: float, ratio: float, most: int, smooth: int = 5, window_ms: float = 3.0, near_ms: float = 10.0):
    """The last sample that starts a click and the interval to cut around it, or None and the detector that had nothing."""
    jumps = np.abs(np.diff(x / (np.abs(x).max(initial=0.0) + 1e-12)))
    if len(jumps) < 5:
        return None, "short"
    line = robust_line(jumps, k)
    if not (jumps > line).any():
        return None, "below_T"
    even = sliding_median(jumps, smooth)
    left, here, right = even[:-2], even[1:-1], even[2:]
    tops = np.flatnonzero((jumps[1:-1] > line) & (here >= left) & (here >= right) & ((here > left) | (here > right))) + 1
    tops = tops if len(tops) else np.array([jumps.argmax()])
    wide = jumps > max(line * WIDTH_SHARES[0], np.median(jumps) * WIDTH_SHARES[1])
    short = np.array([b - a <= max(LEAST_WIDTH, most) for a, b in (run_around(wide, t) for t in tops)])
    window = max(2, round(rate * window_ms / 1000))
    passed = tops[short & _spikes(x, tops + 1, window, max(window + 1, round(rate * near_ms / 1000)), ratio, side)]
    if not len(passed):
        return None, "no_pass_filters"
    top = int(passed[-1])
    a, b = run_around(even > max(robust_line(even, k) * CUT_SHARES[0], np.median(even) * CUT_SHARES[1]), top)
    b = min(len(x), b + 1)
    if b - a > most:
        a = max(0, (a + b) // 2 - most // 2)
        b = min(len(x), a + most)
    return (top + 1, a, b), "high"


def _silent_before(levels: np.ndarray, at: int, line: float) -> int:
    """How many frames right before `at` are below the line, without a break."""
    loud = np.flatnonzero(levels[:at] >= line)
    return at - (int(loud[-1]) + 1 if len(loud) else 0)


def _silent_start(x: np.ndarray, frame: int, hop: int, top_db: float) -> int:
    """Samples before the first two frames in a row, or else the first frame, within top_db of the loud ones."""
    levels = frame_levels(x, frame, hop)
    if not len(levels):
        return 0
    loud = levels >= (np.percentile(levels, 93) + 1e-12) * 10 ** (-top_db / 20)
    for found in (np.flatnonzero(loud[1:] & loud[:-1]), np.flatnonzero(loud)):
        if len(found):
            return int(found[0]) * hop
    return 0


def _faded(y: np.ndarray, upto: int, fade: int) -> np.ndarray:
    """y with nothing before `upto`, but its last `fade` samples falling in a line."""
    out = y.copy()
    fade = max(0, min(fade, upto))
    out[: upto - fade] = 0
    out[upto - fade : upto] *= np.linspace(1, 0, fade + 1)[:-1].astype(out.dtype)
    return out


def edge_clicks(
    y: np.ndarray, rate: int, lead_ms: float = 500.0, trail_ms: float = 500.0, most_ms: float = 40.0, above_db: float = 12.0, action: str = "mute_then_trim", sides: str = "both",
    lead_silence_ms: float | None = None, trail_silence_ms: float | None = None, top_db: float = 34.0, fade_ms: float = 7.0, k: float | None = None, ratio: float | None = None, voice_k: float | None = None,
) -> EdgeClicks:
    """Take clicks from the edges. action: mute (what lies before a leading click and the click itself is silent; from a trailing
    one on nothing is left), mute_then_trim (silence up to the voice goes as well), fade (a ramp only).

    above_db sets how far a click stands out unless k (jumps), ratio (energy) and voice_k say so; lead_silence_ms and
    trail_silence_ms ask for silence before a click.
    """
    y = np.asarray(y, dtype=np.float32)
    k, ratio, voice_k = (given if given is not None else usual for given, usual in ((k, 7.5 + 0.22 * above_db), (ratio, 3.4 + 0.11 * above_db), (voice_k, 6.2 + 0.06 * above_db)))
    ms = lambda n: 1000.0 * n / rate
    frame, most, fade = max(1, int(rate * 0.002)), max(2, int(rate * most_ms / 1000)), max(0, round(rate * fade_ms / 1000))
    hop = max(1, frame // 2)
    told = {"leading_ms": 0.0, "trailing_ms": 0.0, "leading": "none", "trailing": "none"}

    head = y[: int(rate * lead_ms / 1000)]
    head = head[: voice_start(head, rate, voice_k)]
    if sides in ("both", "leading") and len(head) >= 16:
        found, told["leading"] = find_click(head.astype(np.float64), rate, "leading", k, ratio, most)
        if found and lead_silence_ms is not None:
            levels = frame_levels(head, frame, hop)
            line = (np.median(levels) + 1e-8) * 10 ** (above_db / 20) if len(levels) else 1.0
            at = run_around(levels >= line * SILENT_LEAD, max(0, min(found[0] // hop, len(levels) - 1)))[0] if len(levels) else 0  # frames overlap: the click's first
            if ms(_silent_before(levels, at, line * SILENT_LEAD) * hop) + 1e-6 < lead_silence_ms:
                found, told["leading"] = None, "lead_presilence_short"
        if found:
            upto = min(found[2] + fade, len(head))
            if action == "fade":
                upto = min(most, upto)
                y = np.concatenate([y[:upto] * np.linspace(1, 0, upto + 1)[:-1].astype(np.float32), y[upto:]])
            else:
                y = _faded(y, upto, fade)
                if action == "mute_then_trim":
                    more = _silent_start(y[upto:], frame, hop, top_db)
                    y, upto = y[upto + more :], upto + more
            told["leading_ms"] = ms(upto)

    start = max(0, len(y) - int(rate * trail_ms / 1000))
    tail = y[start:].astype(np.float64)
    if sides in ("both", "trailing") and len(y) > frame and int(rate * trail_ms / 1000) > frame and len(tail) > 8:
        found, told["trailing"] = find_click(tail, rate, "trailing", k, ratio, most)
        if found and trail_silence_ms is not None:
            levels = frame_levels(tail, frame, hop)
            noise = np.median(levels[: max(1, int(len(levels) * 0.55))]) + 1e-8
            line = noise * 10 ** (above_db / 20)
            peak = int(np.clip(found[0] // hop, 0, max(0, len(levels) - 1)))
            first = max(0, peak - max(2, most // hop) + 1)
            low = levels[first : peak + 1] < line * SILENT_TRAIL
            quiet = np.flatnonzero(low[1:] & low[:-1])
            at = first + int(quiet[-1]) + 2 if len(quiet) else first + (int(np.flatnonzero(~low)[0]) if (~low).any() else len(low) - 1)
            before = levels[:at]
            floor = max(min(np.percentile(before, 12), line * SILENT_TRAIL), noise * 0.35) * 1.18 if at else 0.0
            if ms(_silent_before(levels, at, floor) * hop) + 1e-6 < trail_silence_ms:
                found, told["trailing"] = None, "trail_presilence_short"
        if found:
            at = start + found[1]
            if action == "fade":
                n = min(most, len(y) - at)
                y = np.concatenate([y[: len(y) - n], y[len(y) - n :] * np.linspace(0, 1, n + 1)[1:].astype(np.float32)])
                told["trailing_ms"] = ms(n)
            else:
                told["trailing_ms"], y = ms(len(y) - at), y[:at]
    return EdgeClicks(y, **told)
