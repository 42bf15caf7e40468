"""All linguistic features of a clip in one struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from koine.functions import text, tokens


def linguistic_features(
    sentence: Column, phonemes: Column, kana: Column, duration: Column | None = None, labels: Column | None = None, excluded: Sequence[str] = tokens.EXCLUDED, down_weight: Sequence[str] = (),
) -> Column:
    """phones and their runs, morae and theirs, accents of full-context labels, pauses, bands, kind of utterance.

    kana: the sentence as it is read, where a reading is at hand. Null texts, phonemes or labels give empty lists; bands
    and rates need morae, the rate a duration.
    """
    none = F.array().cast("array<string>")
    morae = F.coalesce(text.morae(kana), none)
    n, phones = F.size(morae), tokens.phones(phonemes, excluded)
    rate = F.when((duration > 0) & (n > 0), n / duration) if duration is not None else F.lit(None).cast("double")
    accents = F.coalesce(text.accent_nuclei(labels), none) if labels is not None else none
    lengths = F.coalesce(F.transform(text.accent_phrase_lengths(labels), lambda x: text.accent_band(x.cast("int"))), none) if labels is not None else none
    spoken = F.trim(F.coalesce(sentence, F.lit(""))) != ""
    fields = {
        "phones": phones, "biphones": tokens.ngrams(phones, 2), "triphones": tokens.ngrams(phones, 3), "morae": morae, "mora_bigrams": tokens.ngrams(morae, 2), "mora_count": n,
        "accent_nuclei": accents, "accent_phrase_length_bands": lengths, "pause_marks": tokens.boundary_marks(phonemes), "length_band": F.when(n > 0, text.length_band(n)),
        "rate": rate, "rate_band": F.when(rate.isNotNull(), text.rate_band(rate)), "utterance_type": F.when(spoken, text.utterance_type(sentence)), "down_weighted": tokens.down_weighted(phonemes, down_weight),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


#: Families that a selection may count, with the field of linguistic_features that each is read from.
FAMILIES = {
    "phone": "phones", "biphone": "biphones", "triphone": "triphones", "mora": "morae", "mora_bigram": "mora_bigrams", "full_context": "labels", "accent_nucleus": "accent_nuclei",
    "accent_phrase_length": "accent_phrase_length_bands", "pause_boundary": "pause_marks", "sentence_length_band": "length_band", "speaking_rate_band": "rate_band",
    "interrogative_declarative": "utterance_type",
}
#: Those of them that a split may count.
SPLIT_FAMILIES = ("phone", "biphone", "triphone", "mora", "mora_bigram", "full_context")
#: Families with one value a clip.
SINGLE = ("sentence_length_band", "speaking_rate_band", "interrogative_declarative")


def family_tokens(names: Sequence[str], allowed: Sequence[str] = tuple(FAMILIES)) -> dict[str, Column]:
    """Token lists of catalog clips by family, in the order of names; a clip without any of a family has an empty list.
    Names that aren't allowed, or come twice, raise ValueError."""
    if bad := [n for i, n in enumerate(names) if n not in allowed or n in names[:i]]:
        raise ValueError(f"families must be distinct ones of {', '.join(allowed)}, not {bad}")
    none = F.array().cast("array<string>")
    found = linguistic_features(F.col("text_norm"), F.col("phonemes"), F.col("text_norm"), F.col("duration_sec"), F.col("fullcontext_labels"))

    def tokens_of(name: str) -> Column:
        if name == "full_context":
            return F.coalesce("fullcontext_labels", none)
        if name == "mora":
            return F.coalesce("moras", none)
        value = found.getField(FAMILIES[name])
        return F.array_compact(F.array(value)) if name in SINGLE else F.array_compact(F.coalesce(value, none))

    return {name: tokens_of(name) for name in names}
