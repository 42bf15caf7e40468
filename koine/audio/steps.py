"""Processing steps of a recording and their compiler.

A chain is a list of {"type": name, ...parameters}. It runs as one function in one Arrow batch, never a UDF a step.
Steps that need a model (denoisers, restoration, bandwidth extension) are looked up in BACKENDS by their name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from koine.audio.arrays import robust_line, runs
from koine.audio.edge import edge_clicks
from koine.audio.metrics import METRICS, bytes_of, decode, encode_wav, frame_rms, measure
from koine.audio.models import BATCHED, run_model
from koine.audio.noise import centred_spans, lip_noise_spans, lip_noise_suppress, spectral_subtract, wpe
from koine.scratch import ship

#: Steps that need a model: name to (samples, rate, parameters) to samples. Register one to use it.
BACKENDS: dict[str, Callable[[np.ndarray, int, dict], np.ndarray]] = {}
MODEL_STEPS = ("dasheng", "sgmse", "wpe_deepfilternet", "sidon", "hifigan_bwe")


#: Bytes of decoded samples that a chain works on at a time.
LOT = 128 << 20


class Rejected(Exception):
    """A step found that the recording can't be used; its text is the reason."""


# --- helpers ---------------------------------------------------------------------------------------------------------
def merged(intervals: np.ndarray, gap: int, pad: int, n: int) -> list[tuple[int, int]]:
    """Intervals padded, kept inside [0, n) and joined where they are at most `gap` apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a - pad), min(n, b + pad)) for a, b in intervals):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fill_hole(y: np.ndarray, a: int, b: int, kind: str = "cubic") -> None:
    """Replace y[a:b] by a line through its neighbours, or a cubic through two on either side."""
    if kind == "cubic" and a >= 2 and b + 1 < len(y):
        x = np.array([a - 2, a - 1, b, b + 1])
        scale = max(1, b - a)
        y[a:b] = np.polyval(np.polyfit((x - a) / scale, y[x], 3), (np.arange(a, b) - a) / scale)
    elif a > 0 or b < len(y):
        left = y[a - 1] if a > 0 else y[b]
        right = y[b] if b < len(y) else left
        y[a:b] = np.linspace(left, right, b - a + 2)[1:-1]


def _ms(rate: int, ms: float) -> int:
    return max(1, int(rate * ms / 1000))


# --- steps -----------------------------------------------------------------------------------------------------------
def resample(y: np.ndarray, rate: int, target: int, width: int = 32, block: int = 1 << 14) -> tuple[np.ndarray, int]:
    """Windowed-sinc interpolation, low-passed below half of the lower rate; `block` samples at a time, whatever the
    recording's length."""
    if rate == target or not len(y):
        return y, target
    n, cutoff = int(round(len(y) * target / rate)), min(1.0, target / rate)
    reach, out = int(np.ceil(width / cutoff)), np.empty(n, dtype=np.float32)
    for start in range(0, n, block):
        at = np.arange(start, min(n, start + block)) * rate / target
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(1 - reach, reach + 1)
        d = at[:, None] - near
        kernel = cutoff * np.sinc(cutoff * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / reach, -1, 1)))
        values = np.where((near >= 0) & (near < len(y)), y[np.clip(near, 0, len(y) - 1)], 0.0)
        out[start : start + block] = (kernel * values).sum(axis=1)
    return out, target


def trim_silence(
    y: np.ndarray, rate: int, top_db: float = 40.0, frame: int = 2048, hop: int = 512, sides: str = "both", pad_head_ms: float = 0.0, pad_tail_ms: float = 0.0,
    max_keep_sec: float | None = None, reject_if_truncated: bool = True, spike_frames: int = 0,
) -> np.ndarray:
    """Cut what is top_db below the loudest frame at the ends that `sides` names: both, leading or trailing.

    Frames are centred. Trailing only, islands of at most spike_frames frames at the end that silence comes before don't
    count. A recording without a loud frame, or one that a cut would silence, stays. What is longer than max_keep_sec is
    cut off there, and rejected if so asked. Silence is put before and after by the pads.
    """
    if sides not in ("both", "leading", "trailing"):
        raise ValueError(f"sides must be both, leading or trailing, not {sides!r}")
    y = np.nan_to_num(y.astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)
    if not len(y):
        return y
    squares = np.concatenate([[0.0], np.cumsum(np.pad(y.astype(np.float64), frame // 2) ** 2)])
    starts = np.arange(0, len(squares) - frame, hop)
    level = np.maximum(np.maximum(squares[starts + frame] - squares[starts], 0.0) / frame, 1e-10)
    found = runs(10 * np.log10(level / level.max()) > -top_db)
    kept = y
    if len(found):
        last = len(found) - 1
        if sides == "trailing":
            while last > 0 and found[last][1] - found[last][0] <= spike_frames:
                last -= 1
        a = found[0][0] * hop if sides != "trailing" else 0
        b = min(len(y), found[last][1] * hop) if sides != "leading" else len(y)
        kept = y[a:b] if a < b else y
        if np.abs(y).max() > 1e-6 and np.abs(kept).max() < 1e-12:
            kept = y
    most = len(kept) if max_keep_sec is None else int(rate * max_keep_sec)
    if len(kept) > most and reject_if_truncated:
        raise Rejected("trim_exceeds_max_keep_sec")
    return np.pad(kept[:most], (round(pad_head_ms * rate / 1000), round(pad_tail_ms * rate / 1000)))


def loudness(y: np.ndarray, rate: int) -> float:
    """Integrated loudness of ITU-R BS.1770: two weighting filters, gated blocks of 400 ms."""
    def biquad(x, b, a):
        return _filter(x, np.array(b) / a[0], np.array(a) / a[0])

    def shelf(x):
        k, vh = np.tan(np.pi * 1681.974450955533 / rate), 10 ** (3.999843853973347 / 20)
        vb, q = vh**0.4996667741545416, 0.7071752369554196
        return biquad(x, [vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k], [1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])

    def high(x):
        k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
        return biquad(x, [1, -2, 1], [1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])

    x = high(shelf(y.astype(np.float64)))
    size, hop = int(0.4 * rate), int(0.1 * rate)
    power = np.array([np.mean(x[i : i + size] ** 2) for i in range(0, len(x) - size + 1, hop)])
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-15))
    kept = power[level > -70]
    if not len(kept):
        return -np.inf
    kept = power[(level > -70) & (level > -0.691 + 10 * np.log10(kept.mean()) - 10)]
    return float(-0.691 + 10 * np.log10(kept.mean())) if len(kept) else -np.inf


def normalize(y: np.ndarray, rate: int, mode: str = "lufs", target: float = -23.0) -> np.ndarray:
    """To a loudness or a peak in decibels. Short or unmeasurable recordings get a peak of -1 dB. Gains stay within 60 dB."""
    peak = float(np.abs(y).max()) if len(y) else 0.0
    if peak <= 0:
        return y
    level = loudness(y, rate) if mode == "lufs" and len(y) >= 0.4 * rate else -np.inf
    gain = target - level if np.isfinite(level) else (target if mode == "peak" else -1.0) - 20 * np.log10(peak)
    return (y * 10 ** (np.clip(gain, -60, 60) / 20)).astype(np.float32)


def _filter(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A biquad, by powers of its two-by-two state matrix over blocks: no loop over samples."""
    forced = np.convolve(x, b)[: len(x)]
    size = 64
    impulse = np.zeros(size)
    for i in range(size):
        impulse[i] = (i == 0) - (a[1] * impulse[i - 1] if i > 0 else 0) - (a[2] * impulse[i - 2] if i > 1 else 0)
    n = -(-len(x) // size)
    blocks = np.pad(forced, (0, n * size - len(x))).reshape(n, size)
    lower = np.tril(impulse[np.clip(np.subtract.outer(np.arange(size), np.arange(size)), 0, size - 1)])
    own = blocks @ lower.T
    one, two = -a[1] * impulse - a[2] * np.append(0, impulse[:-1]), -a[2] * impulse
    y1 = y2 = 0.0
    for k in range(n):
        own[k] += one * y1 + two * y2
        y1, y2 = own[k, -1], own[k, -2]
    return own.ravel()[: len(x)]


def butterworth(y: np.ndarray, rate: int, cutoff: float, kind: str, order: int = 4) -> np.ndarray:
    """Zero-phase low or high pass: biquads forwards and backwards over a reflected edge."""
    edge = min(len(y) - 1, 3 * order * max(1, int(rate / cutoff)))
    if edge < 1:
        return y
    x = np.concatenate([2 * y[0] - y[edge:0:-1], y, 2 * y[-1] - y[-2 : -edge - 2 : -1]]).astype(np.float64)
    k = np.tan(np.pi * cutoff / rate)
    for i in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * i + 1) / (2 * order)))
        a = np.array([1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k])
        b = np.array([k * k, 2 * k * k, k * k] if kind == "low" else [1, -2, 1])
        for _ in range(2):
            x = _filter(x, b / a[0], a / a[0])[::-1]
    return x[edge : edge + len(y)].astype(np.float32)


def diff_click_repair(
    y: np.ndarray, rate: int, first: float = 9.0, second: float | None = 8.0, both: bool = False, min_jump: float | None = None,
    gap_ms: float = 0.35, pad_ms: float = 1.5, most_ms: float = 20.0, most: int = 256, kind: str = "cubic",
) -> np.ndarray:
    """Replace places where the first or the second difference exceeds its median by so many robust deviations.

    `both` asks for both of them, second=None for the first only; min_jump is a least jump as a share of the peak. A
    place longer than most_ms is cut down to its middle. The `most` places with the largest jumps are replaced, all if it
    is 0. Short recordings and rates below 4 kHz stay as they are.
    """
    if len(y) < 8 or rate < 4000:
        return y.copy()
    x = y.astype(np.float64)
    jumps = np.abs(np.diff(x))

    touched = lambda hit: np.convolve(hit, np.ones(len(x) - len(hit) + 1)) > 0.5  # noqa: E731  samples that a difference reaches
    mask = touched(jumps > max(robust_line(jumps, first), (min_jump or 0.0) * np.abs(x).max()))
    if second is not None:
        bends = np.abs(np.diff(x, n=2))
        mask = (np.logical_and if both else np.logical_or)(mask, touched(bends > robust_line(bends, second)))
    samples = lambda ms: round(ms * rate / 1000)
    spans = np.array(merged(runs(mask), samples(gap_ms), 0, len(y)), dtype=np.int64).reshape(-1, 2)
    spans = np.clip(spans + [-samples(pad_ms), samples(pad_ms)], 0, len(y))
    spans = centred_spans(spans, spans.sum(axis=1) // 2, max(4, samples(most_ms)), len(y))
    found = merged(spans, 0, 0, len(y))
    strongest = np.argsort([-jumps[max(0, a - 1) : b].max(initial=0.0) for a, b in found], kind="stable")
    found = [found[k] for k in strongest[: most or None]]
    out = y.copy()
    for a, b in found:
        fill_hole(out, a, b, kind)
    return out


def lip_noise_repair(y: np.ndarray, rate: int, kind: str = "linear", **rules) -> np.ndarray:
    """Replace short transients (lip_noise_spans) by interpolation."""
    out = y.astype(np.float32).copy()
    for a, b in lip_noise_spans(y, rate, **rules):
        fill_hole(out, a, b, kind)
    return out


def _plain(f):
    return lambda y, rate, p: (f(y, rate, **p), rate)


STEPS: dict[str, Callable[[np.ndarray, int, dict], tuple[np.ndarray, int]]] = {
    "decode": lambda y, rate, p: (y, rate),
    "save_wav": lambda y, rate, p: (y, rate),
    "resample": lambda y, rate, p: resample(y, rate, p["target"]),
    "trim_silence": _plain(trim_silence),
    "normalize": _plain(normalize),
    "low_pass": _plain(lambda y, rate, cutoff, order=4: butterworth(y, rate, cutoff, "low", order)),
    "high_pass": _plain(lambda y, rate, cutoff, order=4: butterworth(y, rate, cutoff, "high", order)),
    "lip_noise_suppress": _plain(lip_noise_suppress),
    "lip_noise_repair": _plain(lip_noise_repair),
    "diff_click_repair": _plain(diff_click_repair),
    "edge_click": _plain(lambda y, rate, **p: edge_clicks(y, rate, **p).y),
    "wpe": _plain(wpe),
}


def denoise(y: np.ndarray, rate: int, p: dict) -> tuple[np.ndarray, int]:
    backend = p.get("backend", "none")
    rest = {k: v for k, v in p.items() if k != "backend"}
    if backend == "none":
        return y, rate
    if backend == "spectral_subtract":
        return spectral_subtract(y, rate, **rest), rate
    if backend == "wpe_deepfilternet":  # the first half needs no model
        y = wpe(y, rate, **rest.pop("wpe", {}))
    if backend in BATCHED:
        bounds = {k: rest.pop(k) for k in ("most_bytes", "chunk_sec", "overlap_sec") if k in rest}
        return run_model(BATCHED[backend], [y], rate, rest, **bounds)[0], rate
    if backend not in BACKENDS:
        raise ValueError(f"no backend named {backend!r} is registered")
    return BACKENDS[backend](y, rate, rest), rate


def compiled(chain: Sequence[dict], skip_denoise: bool = False) -> list[dict]:
    """The chain as it runs: decoding first; edge steps marked `post_spectral` after the last spectral step; without
    denoising where a first pass leaves it to a second."""
    steps = [s for s in chain if not (skip_denoise and s["type"] == "denoise")]
    unknown = [s["type"] for s in steps if s["type"] not in STEPS and s["type"] != "denoise" and s["type"] not in MODEL_STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}")
    if not steps or steps[0]["type"] != "decode":
        steps = [{"type": "decode"}, *steps]
    late = [s for s in steps if s["type"] == "edge_click" and s.get("post_spectral")]
    steps = [s for s in steps if s not in late]
    spectral = [i for i, s in enumerate(steps) if s["type"] in ("denoise", "lip_noise_suppress", "wpe", *MODEL_STEPS)]
    at = spectral[-1] + 1 if spectral else len(steps)
    return steps[:at] + late + steps[at:]


def _backend(step: dict) -> str:
    return step.get("backend", "none") if step["type"] == "denoise" else step["type"] if step["type"] in MODEL_STEPS else "none"


def run_all(items: Sequence[tuple[np.ndarray, int]], chain: Sequence[dict]) -> list[tuple[np.ndarray, int] | Exception]:
    """Recordings through the chain, each with its samples and rate or with what went wrong. A step of a registered batch
    model takes all recordings of one rate together; a batch that fails is taken up one by one."""
    out: list = list(items)

    def each(places, f) -> None:
        for i in places:
            try:
                out[i] = f(*out[i])
            except Exception as e:  # one bad recording doesn't stop the others
                out[i] = e

    for step in chain:
        kind, p = step["type"], {k: v for k, v in step.items() if k not in ("type", "post_spectral")}
        good, name = [i for i, x in enumerate(out) if not isinstance(x, Exception)], _backend(step)
        if name == "none" and kind != "denoise":
            each(good, lambda y, rate: STEPS[kind](y, rate, p))
            continue
        alone = lambda y, rate: denoise(y, rate, {**p, "backend": name})
        if name not in BATCHED:
            each(good, alone)
            continue
        bounds = {k: p[k] for k in ("most_bytes", "chunk_sec", "overlap_sec") if k in p}
        rest = {k: v for k, v in p.items() if k not in (*bounds, "backend", "wpe")}
        rates = {i: out[i][1] for i in good}
        for rate in sorted(set(rates.values())):
            own = [i for i in good if rates[i] == rate]
            try:
                before = [wpe(out[i][0], rate, **p.get("wpe", {})) if name == "wpe_deepfilternet" else out[i][0] for i in own]
                after = run_model(BATCHED[name], before, rate, rest, **bounds)
            except Exception:
                each(own, alone)
            else:
                for i, y in zip(own, after, strict=True):
                    out[i] = (y, rate)
    return out


def run(y: np.ndarray, rate: int, chain: Sequence[dict]) -> tuple[np.ndarray, int]:
    done = run_all([(y, rate)], chain)[0]
    if isinstance(done, Exception):
        raise done
    return done


_METRIC_NAMES = [x.split()[0] for x in METRICS.split(", ")]
PROCESSED = T.StructType(
    [T.StructField("content", T.BinaryType()), T.StructField("reason", T.StringType()), T.StructField("m", T.StructType([T.StructField(n, T.DoubleType()) for n in _METRIC_NAMES]))]
)


def _processor(chain: Sequence[dict], skip_denoise: bool, early, keep: bool):
    """A function of recordings and their texts' lengths, in order, to ((content, reason, measures), bytes) as they are done,
    in lots of at most about LOT bytes of samples."""
    steps, none = compiled(chain, skip_denoise), dict.fromkeys(_METRIC_NAMES)

    def opened(x, letters: int):
        y, rate = decode(bytes_of(x))
        if early and (reason := early(measure(y, rate), letters)):
            raise Rejected(reason)
        return y, rate

    def told(x) -> tuple:
        if x is None:
            return None, None, none
        if isinstance(x, Exception):
            return None, str(x) if isinstance(x, Rejected) else f"audio_error: {type(x).__name__}", none
        written = encode_wav(*x)
        return written if keep else None, None, measure(*decode(written))

    def process(rows) -> Iterator[list[tuple]]:
        lot, held = [], 0

        def done() -> list[tuple]:
            good = [i for i, x in enumerate(lot) if isinstance(x, tuple)]
            for i, x in zip(good, run_all([lot[i] for i in good], steps), strict=True):
                lot[i] = x
            return [told(x) for x in lot]

        for x, letters in rows:
            try:
                lot.append(None if x is None else opened(x, letters))
            except Exception as e:  # one bad recording doesn't stop the others
                lot.append(e)
            held += lot[-1][0].nbytes if isinstance(lot[-1], tuple) else 0
            if held >= LOT:
                yield done()
                lot, held = [], 0
        if lot:
            yield done()

    return process


def process_udf(chain: Sequence[dict], skip_denoise: bool = False, early: Callable[[dict, int], str | None] | None = None):
    """Columns of recordings (contents or URIs) and their texts' lengths to (content, reason, m): processed with its measures, or
    why not. A recording is decoded once; `early` may turn it down by its measures before the chain. An Arrow batch is
    given back whole; processed() bounds what it gives back by bytes."""
    process = _processor(chain, skip_denoise, early, True)

    @F.pandas_udf(PROCESSED)
    def udf(content: pd.Series, letters: pd.Series) -> pd.DataFrame:
        out = [x for lot in process(zip(content, letters, strict=True)) for x in lot]
        measures = pd.DataFrame([m for _, _, m in out], columns=_METRIC_NAMES)
        return pd.DataFrame({"content": [c for c, _, _ in out], "reason": [r for _, r, _ in out], "m": measures.to_dict("records")})

    return lambda content, letters=F.lit(0): udf(content, letters)


def processed(df: DataFrame, recording: str, chain: Sequence[dict], name: str = "processed", letters: str | None = None, skip_denoise: bool = False, early=None, keep: bool = True) -> DataFrame:
    """df with a struct `name` of (content, reason, m), as process_udf; recording and letters name columns of df. Rows come and go in
    Arrow batches cut where about LOT bytes of samples are reached, whatever their number. Without `keep` the contents
    stay behind."""
    ship(df.sparkSession)
    process, kind = _processor(chain, skip_denoise, early, keep), to_arrow_type(PROCESSED)

    def through(batches):
        for b in batches:
            sizes = b.column(letters).to_pylist() if letters else [0] * b.num_rows
            at = 0
            for lot in process(zip(b.column(recording).to_pylist(), sizes, strict=True)):
                made = pa.array([{"content": c, "reason": r, "m": m} for c, r, m in lot], kind)
                yield pa.record_batch([*b.slice(at, len(lot)).columns, made], names=[*b.schema.names, name])
                at += len(lot)

    return df.mapInArrow(through, T.StructType([*df.schema.fields, T.StructField(name, PROCESSED)]))


def level_db(y: np.ndarray, rate: int) -> np.ndarray:
    """Frame levels in decibels."""
    return 20 * np.log10(np.maximum(frame_rms(y, rate), 1e-9))
