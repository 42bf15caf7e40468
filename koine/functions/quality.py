"""Recording quality: score, tier and the ordered reasons of the gates, over columns of measured values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Limits of a gate; None switches a check off."""

    min_duration_sec: float = 0.5
    max_duration_sec: float = 20.0
    max_silence_ratio: float = 0.6
    max_trailing_silence_sec: float | None = None
    min_estimated_snr_db: float | None = None
    max_clipping_ratio: float = 0.01
    max_abs_dc_offset: float = 0.05
    min_chars_per_sec: float | None = None
    max_chars_per_sec: float | None = None
    min_sec_per_mora: float | None = None
    mora_relax: float = 1.0
    tier_mode: str = "annotate"
    a_min_snr_db: float = 20.0
    a_max_silence_ratio: float = 0.35
    a_max_clipping_ratio: float = 0.001
    a_max_trailing_silence_sec: float | None = None
    b_min_snr_db: float = 12.0
    b_max_silence_ratio: float = 0.5
    unknown_snr_silence_a: float = 0.3
    unknown_snr_silence_b: float = 0.5

    def merged(self, profile: dict | None = None, overrides: dict | None = None) -> Gate:
        """Profile below this gate's own settings, overrides above both."""
        own = {k: v for k, v in vars(self).items() if v != vars(type(self)()).get(k)}
        return replace(type(self)(), **{**(profile or {}), **own, **(overrides or {})})


def quality_score(snr: Column, silence: Column, clipping: Column, gate: Gate = Gate()) -> Column:
    """0 to 100 of noise (50; 22 where unknown), silence (35) and clipping (15), at two digits."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    span, clip = max(gate.max_silence_ratio, 1e-6), max(gate.max_clipping_ratio, 1e-9)
    noise = F.when(snr.isNull(), 22.0).otherwise(50.0 * unit((snr - 3.0) / 22.0))
    return F.round(noise + 35.0 * unit((span - silence) / span) + 15.0 * unit((clip - clipping) / clip), 2)


def quality_tier(snr: Column, silence: Column, clipping: Column, trailing: Column | None = None, gate: Gate = Gate()) -> Column:
    """A, B or C; a long silence at the end caps A."""
    lower = F.when(snr.isNotNull() & (snr >= gate.b_min_snr_db) & (silence <= gate.b_max_silence_ratio), "B").when(
        snr.isNull() & (silence <= gate.unknown_snr_silence_b), "B"
    ).otherwise("C")
    top = F.when(
        snr.isNotNull(), (snr >= gate.a_min_snr_db) & (silence <= gate.a_max_silence_ratio) & (clipping <= gate.a_max_clipping_ratio)
    ).otherwise((clipping <= gate.a_max_clipping_ratio) & (silence <= gate.unknown_snr_silence_a))
    if gate.a_max_trailing_silence_sec is not None and trailing is not None:
        top = top & (trailing <= gate.a_max_trailing_silence_sec + 1e-9)
    return F.when(top, "A").otherwise(lower)


def gate_reason(metrics: Column, text_length: Column, mora_count: Column | None = None, gate: Gate = Gate()) -> Column:
    """The first check of the final gate that a clip fails, or null.

    metrics: struct of duration_sec, silence_ratio, trailing_silence_sec, snr_db (nullable), clipping_ratio, dc_offset.
    """
    m = lambda name: metrics.getField(name)
    duration, snr = m("duration_sec"), m("snr_db")
    reason = F.when((duration < gate.min_duration_sec) | (duration > gate.max_duration_sec), "gate_duration")
    reason = reason.when(m("silence_ratio") > gate.max_silence_ratio, "gate_silence")
    if gate.max_trailing_silence_sec is not None:
        reason = reason.when(m("trailing_silence_sec") > gate.max_trailing_silence_sec + 1e-9, "gate_trailing_silence")
    if gate.min_estimated_snr_db is not None:
        reason = reason.when(snr < gate.min_estimated_snr_db, "gate_snr")
    reason = reason.when(m("clipping_ratio") > gate.max_clipping_ratio, "gate_clipping")
    reason = reason.when(m("dc_offset") > gate.max_abs_dc_offset, "gate_dc")
    pace = F.when(duration > 0, text_length / duration).otherwise(0.0)
    if gate.min_chars_per_sec is not None:
        reason = reason.when(pace < gate.min_chars_per_sec, "gate_text_audio_low")
    if gate.max_chars_per_sec is not None:
        reason = reason.when(pace > gate.max_chars_per_sec, "gate_text_audio_high")
    if gate.min_sec_per_mora is not None and mora_count is not None:
        needed = mora_count * gate.min_sec_per_mora * gate.mora_relax
        reason = reason.when((mora_count > 0) & (duration + 1e-9 < needed), "gate_text_audio_mora")
    if gate.tier_mode in ("reject_c", "reject_b"):
        tier = quality_tier(snr, m("silence_ratio"), m("clipping_ratio"), m("trailing_silence_sec"), gate)
        reason = reason.when(tier == "C", "gate_quality_tier_c")
        if gate.tier_mode == "reject_b":
            reason = reason.when(tier == "B", "gate_quality_tier_b")
    return reason


@dataclass(frozen=True)
class EarlyGate:
    """Checks of the early gate, which runs before a chain that costs much; limits are those of the final gate."""

    duration: bool = True
    silence_ratio: bool = False
    snr: bool = False
    clipping: bool = False
    dc_offset: bool = False
    chars_per_sec: bool = False
    mora_duration: bool = False

    def reason(self, gate: Gate):
        """(measures, letters, morae) to the first check that a recording fails, or None."""

        def check(m: dict, letters: int, morae: int | None = None) -> str | None:
            seconds = m["duration_sec"]
            pace = letters / seconds if seconds > 0 else 0.0
            needed = (morae or 0) * (gate.min_sec_per_mora or 0.0) * gate.mora_relax
            checks = (
                (self.duration, not gate.min_duration_sec <= seconds <= gate.max_duration_sec, "duration"),
                (self.silence_ratio, m["silence_ratio"] > gate.max_silence_ratio, "silence"),
                (self.snr, gate.min_estimated_snr_db is not None and m["snr_db"] is not None and m["snr_db"] < gate.min_estimated_snr_db, "snr"),
                (self.clipping, m["clipping_ratio"] > gate.max_clipping_ratio, "clipping"),
                (self.dc_offset, m["dc_offset"] > gate.max_abs_dc_offset, "dc"),
                (self.chars_per_sec, gate.min_chars_per_sec is not None and pace < gate.min_chars_per_sec, "text_audio_low"),
                (self.chars_per_sec, gate.max_chars_per_sec is not None and pace > gate.max_chars_per_sec, "text_audio_high"),
                (self.mora_duration, seconds + 1e-9 < needed, "text_audio_mora"),
            )
            return next((f"early_gate_{name}" for on, bad, name in checks if on and bad), None)

        return check


@dataclass(frozen=True)
class AsrGate:
    min_chars: int = 1
    length_ratio: tuple[float, float] | None = (0.5, 2.0)
    min_confidence: float | None = None
    max_cer: float | None = 0.3
    max_per: float | None = None


def asr_reason(hypothesis: Column, reference: Column, confidence: Column, cer: Column, per: Column | None, decoded: Column, gate: AsrGate = AsrGate()) -> Column:
    """The first check of the transcription gate that a clip fails, or null."""
    n, m = F.length(hypothesis), F.length(reference)
    reason = F.when(~F.coalesce(decoded, F.lit(True)), "asr_decode_failed").when(hypothesis.isNull(), "asr_missing")
    reason = reason.when(n < gate.min_chars, "asr_too_short")
    if gate.length_ratio:
        ratio = n / F.greatest(m, F.lit(1))
        reason = reason.when((ratio < gate.length_ratio[0]) | (ratio > gate.length_ratio[1]), "asr_length_ratio")
    if gate.min_confidence is not None:
        reason = reason.when(confidence < gate.min_confidence, "asr_confidence")
    if gate.max_cer is not None:
        reason = reason.when(cer > gate.max_cer, "asr_cer")
    if gate.max_per is not None and per is not None:
        reason = reason.when(per > gate.max_per, "asr_per")
    return reason


def aligner_reason(predicted: Column, expected: Column, kind: str, max_rate: float = 0.0) -> Column:
    """Rejects of the forced aligners on token lists."""
    from koine.functions.tokens import token_error_rate

    return F.when(predicted.isNull() | (F.size(predicted) == 0), f"{kind}_missing").when(token_error_rate(predicted, expected) > max_rate, f"{kind}_token_mismatch")
