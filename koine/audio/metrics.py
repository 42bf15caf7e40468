"""Measures of a recording: what the gates decide by."""

from __future__ import annotations

import io
import shutil
import subprocess
import wave
from collections.abc import Callable
from dataclasses import dataclass
from urllib.request import url2pathname

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Frames:
    frame_ms: float = 25.0
    hop_ms: float = 10.0
    silence_floor: float = 0.05
    silence_percentile: float = 100.0
    noise_percentile: float = 15.0
    signal_percentile: float = 60.0
    least: int = 4


#: Decoders beside PCM wav, asked in turn: content to (mono samples in [-1, 1], rate), or None for another format.
DECODERS: list[Callable[[bytes], tuple[np.ndarray, int] | None]] = []


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a recording: PCM wav here, other formats by DECODERS, by soundfile where it is installed,
    or by an ffmpeg on the path. No decoder is an error."""
    if content[:4] == b"RIFF":
        try:
            return decode_wav(content)
        except wave.Error:  # not PCM
            pass
    for one in (*DECODERS, _soundfile, _ffmpeg):
        if (found := one(content)) is not None:
            y = np.asarray(found[0], dtype=np.float32)
            if not np.isfinite(y).all():
                raise ValueError("samples that are no numbers")
            return y, int(found[1])
    raise ValueError("no decoder knows this format")


def _soundfile(content: bytes) -> tuple[np.ndarray, int] | None:
    try:
        import soundfile
    except ImportError:
        return None
    try:
        y, rate = soundfile.read(io.BytesIO(content), dtype="float32", always_2d=True)
    except RuntimeError:
        return None
    return y.mean(axis=1), rate


def _ffmpeg(content: bytes) -> tuple[np.ndarray, int] | None:
    if not (program := shutil.which("ffmpeg")):
        return None
    done = subprocess.run([program, "-v", "error", "-i", "pipe:0", "-f", "wav", "-acodec", "pcm_s16le", "-"], input=content, capture_output=True, timeout=300)
    # a pipe has no length to write into the header, so the samples' size is taken from what came
    if done.returncode or len(done.stdout) < 44 or (at := done.stdout.find(b"data")) < 0:
        return None
    channels, rate = int.from_bytes(done.stdout[22:24], "little"), int.from_bytes(done.stdout[24:28], "little")
    x = np.frombuffer(done.stdout[at + 8 : at + 8 + (len(done.stdout) - at - 8) // (2 * channels) * 2 * channels], dtype="<i2")
    return x.reshape(-1, channels).mean(axis=1) / 32768.0, rate


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        n, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        x = np.pad(b, ((0, 0), (1, 0))).copy().view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, dtype={1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    y = x.reshape(-1, n).mean(axis=1).astype(np.float32)
    if not np.isfinite(y).all():
        raise ValueError("samples that are no numbers")
    return y, rate


def encode_wav(y: np.ndarray, rate: int) -> bytes:
    """PCM of 16 bits; samples beyond 1 are clipped. An empty recording, or one with non-numbers, is an error."""
    if not len(y) or not np.isfinite(y).all():
        raise ValueError("nothing that could be written")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def frame_levels(y: np.ndarray, rate: int, f: Frames = Frames(), flush: bool = True) -> np.ndarray:
    """Mean square of each frame. Frames begin every hop; the last one may be flush with the end, unless `flush` is off."""
    size, hop = max(1, int(rate * f.frame_ms / 1000)), max(1, int(rate * f.hop_ms / 1000))
    starts = np.arange(0, len(y) - size + bool(flush), hop)
    sums = np.concatenate([[0.0], np.cumsum(np.asarray(y, dtype=np.float64) ** 2)])
    return np.maximum(sums[starts + size] - sums[starts], 0.0) / size


def frame_rms(y: np.ndarray, rate: int, f: Frames = Frames()) -> np.ndarray:
    """Root mean squares of frames that end before the last sample."""
    return np.sqrt(frame_levels(y, rate, f, flush=False) + 1e-18)


def silence(y: np.ndarray, rate: int, f: Frames = Frames()) -> tuple[float, float]:
    """Share of silent frames and seconds of them at the end, against a percentile of the frames."""
    rms = frame_rms(y, rate, f)
    if not len(rms):
        return 0.0, 0.0
    quiet = rms < f.silence_floor * (np.percentile(rms, min(f.silence_percentile, 100)) + 1e-12)
    size, hop = max(1, int(rate * f.frame_ms / 1000)), max(1, int(rate * f.hop_ms / 1000))
    tail = len(quiet) if quiet.all() else int(np.argmin(quiet[::-1]))
    return float(quiet.mean()), 0.0 if len(y) < size + hop else tail * hop / rate


def snr_db(y: np.ndarray, rate: int, f: Frames = Frames()) -> float | None:
    """Ratio in decibels of two percentiles of the frames' energy, the loud one by the quiet one; none for recordings of
    few frames or without a difference."""
    energy = frame_levels(y, rate, f) + 1e-12
    if len(energy) < f.least:
        return None
    noise, signal = np.percentile(energy, [f.noise_percentile, f.signal_percentile])
    return float(10 * np.log10(signal / noise)) if signal > noise else None


def measure(y: np.ndarray, rate: int, f: Frames = Frames()) -> dict:
    share, tail = silence(y, rate, f)
    size = np.abs(y)
    return {
        "duration_sec": len(y) / rate if rate else 0.0,
        "silence_ratio": share,
        "trailing_silence_sec": tail,
        "snr_db": snr_db(y, rate, f),
        "clipping_ratio": float((size >= 0.999).mean()) if len(y) else 0.0,
        "dc_offset": float(abs(np.mean(y))) if len(y) else 0.0,
    }


def cheap(y: np.ndarray, rate: int) -> dict:
    """Signs that cost little: peak, level, clipping at 0.99, silent frames of 20 ms below 0.01."""
    if not len(y):
        return {"decode_ok": False, "peak": None, "rms": None, "clipping_ratio": None, "silence_ratio": None}
    frame = max(1, int(rate * 0.02))
    whole = y[: len(y) // frame * frame].reshape(-1, frame) if len(y) >= frame else y[None, :]
    return {
        "decode_ok": True,
        "peak": float(np.abs(y).max()),
        "rms": float(np.sqrt((y.astype(np.float64) ** 2).mean())),
        "clipping_ratio": float((np.abs(y) >= 0.99).mean()),
        "silence_ratio": float((np.sqrt((whole.astype(np.float64) ** 2).mean(axis=1)) < 0.01).mean()),
    }


METRICS = "duration_sec double, silence_ratio double, trailing_silence_sec double, snr_db double, clipping_ratio double, dc_offset double"
CHEAP = "decode_ok boolean, peak double, rms double, clipping_ratio double, silence_ratio double"


def bytes_of(x) -> bytes:
    """A recording's bytes: as they are, or read in the worker from a URI that pyarrow knows or a path that all workers share."""
    if not isinstance(x, str):
        return bytes(x)
    if x.startswith("file:"):
        x = url2pathname(x.removeprefix("file:")) if not x.startswith("file://") else url2pathname(x.removeprefix("file://"))
    if "://" in x:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(x)
        with system.open_input_stream(path) as f:
            return f.read()
    with open(x, "rb") as f:
        return f.read()


def _measured(measure_one, fields: str):
    pairs = [x.split() for x in fields.split(", ")]
    names = [name for name, _ in pairs]
    kinds = {"double": T.DoubleType(), "boolean": T.BooleanType()}

    @F.pandas_udf(T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs]))
    def udf(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append(measure_one(*decode(bytes_of(c))))
            except Exception:  # a recording that can't be decoded has no measures
                rows.append(dict.fromkeys(names) | ({"decode_ok": False} if "decode_ok" in names else {}))
        return pd.DataFrame(rows, columns=names)

    return udf


#: Columns of recordings, contents or URIs, to structs of measures.
metrics_udf = _measured(measure, METRICS)
cheap_udf = _measured(cheap, CHEAP)
