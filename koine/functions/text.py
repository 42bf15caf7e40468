"""Text: normalisation, script tests, validation reasons, kana morae, bands and utterance types."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small kana that belong to the mora before them.
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"
#: Kana and kanji ranges.
JAPANESE = r"[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FFF\u3400-\u4DBF々〆〇]"


#: Texts of a batch that are Python strings at once.
STEP = 64


@F.arrow_udf(T.StringType())
def nfkc_udf(texts: pa.Array) -> pa.Array:
    """Compatibility form; the JVM's functions have none. A batch may hold 10 000 long texts: they are unpacked a few at a time."""
    if not len(texts):
        return pa.array([], pa.string())
    forms = (pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.slice(i, STEP).to_pylist()], pa.string()) for i in range(0, len(texts), STEP))
    return pa.concat_arrays(list(forms))


def compatible(text: Column) -> Column:
    """ASCII is in compatibility form already and needs no Python."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(nfkc_udf(F.when(~ascii_only, text)))


def collapse(text: Column) -> Column:
    """Non-breaking spaces become spaces, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    return collapse(compatible(text))


def normalize_for_tts(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(text), r"\.{2,}", "."))


def collapse_ascii(text: Column) -> Column:
    """Lower case and single spaces, for texts that are in compatibility form already: no Python."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r]+", " "))


def japanese_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, JAPANESE.replace("[", "[^", 1), "")) / n).otherwise(0.0)


def locale_passes(locale: Column, expected: str) -> Column:
    """A missing locale passes; another must begin with the expected one."""
    if not expected:
        return F.lit(True)
    return F.coalesce(F.startswith(F.lower(F.trim(locale)), F.lit(expected.strip().lower())), F.lit(True))


def text_reason(text: Column, locale: Column, expected: str = "ja", least: int = 2, most: int = 120, ratio: float | None = 0.5) -> Column:
    """The first reason against a text, or null: text_locale, text_not_japanese, text_length."""
    reason = F.when(~locale_passes(locale, expected), "text_locale")
    if ratio is not None:
        reason = reason.when(japanese_ratio(text) < ratio, "text_not_japanese")
    n = F.length(F.coalesce(text, F.lit("")))
    return reason.when((n < least) | (n > most), "text_length")


def morae(kana: Column) -> Column:
    """Kana cut into morae: small kana join the one before, a geminate or a long vowel is one of its own."""
    plain = F.regexp_replace(kana, r"(?U)\s+", "")
    return F.regexp_extract_all(plain, F.lit(f".[{SMALL_KANA}]*"), 0)


def length_band(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 7, "4-7").when(n <= 15, "8-15").otherwise("16+")


def accent_band(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 7, "5-7").otherwise("8+")


def rate_band(rate: Column) -> Column:
    return F.when(rate < 5, "slow").when(rate <= 9, "normal").otherwise("fast")


def utterance_type(text: Column) -> Column:
    return F.when(text.rlike(r"[？?か]\p{Zs}*\z"), "interrogative").otherwise("declarative")


def accent_labels(labels: Column, pattern: str) -> Column:
    """Distinct first groups of a pattern over full-context labels, in their order."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""))


def accent_phrase_lengths(labels: Column) -> Column:
    """Lengths of accent phrases, from the F fields, each once."""
    return F.filter(accent_labels(labels, r"(?:^|/)F:(\d+)_\d+#"), lambda x: x.cast("int") > 0)


def accent_nuclei(labels: Column) -> Column:
    """nucleus@PHONE:pLENGTH_nPLACE of each label with an E field that has both, each once; PHONE is what stands before
    the label's first hyphen."""
    field = r"(?:^|/)E:(\d+)_\d+![^/]*-(\d+)"
    name = lambda x: F.concat(F.lit("nucleus@"), F.substring_index(x, "-", 1), F.lit(":p"), F.regexp_extract(x, field, 1), F.lit("_n"), F.regexp_extract(x, field, 2))
    return F.array_distinct(F.transform(F.filter(labels, lambda x: x.rlike(field)), name))


def pipe_safe(text: Column) -> Column:
    """No field or line separators of pipe-separated files."""
    return F.trim(F.regexp_replace(text, r"[|\r\n]+", " "))
