"""What needs a model is reached through a name: readings (text to phonemes) and transcriptions (recording to text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readings by name: a normalised text to its phonemes, words parted by `|`, or None. Register one to use it.
READINGS: dict[str, Callable[[str], str | None]] = {"words": lambda text: " | ".join(text.lower().split())}
#: Transcribers by name: a batch of recordings to their texts; None where one can't be decoded.
TRANSCRIBERS: dict[str, Callable[[list[bytes]], list[str | None]]] = {}


def phonemes(text: Column, backend: str = "words", separator: str = " | ") -> Column:
    """Phonemes of texts by a registered reading; words are joined by `separator`. A text that it can't read gets null."""
    if backend not in READINGS:
        raise ValueError(f"no reading named {backend!r} is registered")
    read = READINGS[backend]

    @F.pandas_udf(T.StringType())
    def udf(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not (t or "").strip():
                return None
            try:
                found = read(t)
            except Exception:  # a text that can't be read has no phonemes
                return None
            return separator.join(w.strip() for w in found.split("|") if w.strip()) or None if found else None

        return texts.map(one)

    return udf(text)


def mock_transcript(text: Column, mode: str = "echo") -> Column:
    """What a transcriber would say, made from the text: the same (echo), one sign more (mismatch_char), nothing (empty)."""
    told = F.coalesce(text, F.lit(""))
    modes = {"echo": told, "mismatch_char": F.concat(told, F.lit("＠")), "empty": F.lit("")}
    if mode not in modes:
        raise ValueError(f"mode must be one of {sorted(modes)}, not {mode!r}")
    return modes[mode]


def transcripts(content: Column, backend: str) -> Column:
    """Texts of recordings by a registered transcriber, a batch at a time."""
    if backend not in TRANSCRIBERS:
        raise ValueError(f"no transcriber named {backend!r} is registered")
    transcribe = TRANSCRIBERS[backend]

    @F.pandas_udf(T.StringType())
    def udf(contents: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(contents)
        at = [i for i, c in enumerate(contents) if c is not None]
        for i, told in zip(at, transcribe([bytes(contents.iloc[i]) for i in at]), strict=True):
            out[i] = told
        return pd.Series(out, dtype="object")

    return udf(content)
