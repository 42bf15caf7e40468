"""Look-ups between the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.scratch import chunked


def plan_with_clips(plan: DataFrame, clips: DataFrame) -> DataFrame:
    """Planned clips with their catalog rows; a plan that names an unknown clip is an error."""
    missing = plan.join(clips, "clip_id", "left_anti").select("clip_id").limit(5).collect()
    if missing:
        raise ValueError(f"the plan names clips that the catalog lacks: {[r.clip_id for r in missing]}")
    return plan.join(clips.drop(*(set(plan.columns) & set(clips.columns)) - {"clip_id"}), "clip_id")


def with_split(clips: DataFrame, assignment: DataFrame, default: str | None = "train") -> DataFrame:
    """Clips with the split of their speaker; speakers without one get the default, or go if there is none."""
    joined = clips.drop("split").join(assignment.select("speaker_id", "split"), "speaker_id", "left" if default else "inner")
    return joined.withColumn("split", F.coalesce("split", F.lit(default))) if default else joined


def apply_overrides(clips: DataFrame, overrides: DataFrame) -> DataFrame:
    """Clips with the action that overrides name for them."""
    return clips.join(overrides.select("clip_id", F.col("action").alias("override_action")), "clip_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: str = "clip_id") -> DataFrame:
    """Rows of both; where both have the key the new one's."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def reusable(rows: DataFrame, prior: DataFrame, pipeline_hash: str) -> DataFrame:
    """rows(path, row_index, text_raw) with `reuse`: whether a prior row of the same place, text and pipeline settled it."""
    known = prior.where(F.col("disposition").isin(*SETTLED)).select(
        F.col("path"), F.col("row_index"), F.col("text_raw").alias("__text"), F.col("pipeline_hash").alias("__hash"), F.col("clip_id").alias("prior_clip_id")
    )
    same = (F.col("__text").eqNullSafe(F.col("text_raw"))) & (F.col("__hash") == pipeline_hash)
    out = rows.join(known, ["path", "row_index"], "left").withColumn("reuse", F.coalesce(same, F.lit(False)))
    return out.withColumn("prior_clip_id", F.when(F.col("reuse"), F.col("prior_clip_id"))).drop("__text", "__hash")


#: Dispositions of rows that an analysis settled.
SETTLED = ("hard_rejected", "eligible", "selected", "reserve")


def reusable_by_id(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """rows(clip_id) with `reuse`: whether a prior row of the clip settled it; for a part of a catalog analysed anew."""
    known = prior.where(F.col("disposition").isin(*SETTLED)).select("clip_id", F.lit(True).alias("__known")).distinct()
    return rows.join(known, "clip_id", "left").withColumn("reuse", F.coalesce("__known", F.lit(False))).drop("__known")


def reusable_index(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """rows(source_path, source_row_index, sentence, audio_sha256) with `reuse`: whether the index before has the place with
    the same sentence and recording. A missing recording was missing before."""
    known = prior.select("source_path", "source_row_index", F.col("sentence").alias("__sentence"), F.nullif("audio_sha256", F.lit("")).alias("__sha"), F.col("clip_id").alias("prior_clip_id"))
    same = F.col("__sentence").eqNullSafe(F.col("sentence")) & F.col("__sha").eqNullSafe(F.nullif("audio_sha256", F.lit("")))
    out = rows.join(known, ["source_path", "source_row_index"], "left").withColumn("reuse", F.col("prior_clip_id").isNotNull() & same)
    return out.withColumn("prior_clip_id", F.when(F.col("reuse"), F.col("prior_clip_id"))).drop("__sentence", "__sha")


def manifest_phonemes(clips: DataFrame, manifest: DataFrame, policy: str = "skip") -> DataFrame:
    """Clips with the phonemes of an alignment manifest; those without are left or rejected by policy."""
    joined = clips.join(manifest.select("source_path", F.col("phonemes").alias("aligned_phonemes")), "source_path", "left")
    reason = F.when(F.col("aligned_phonemes").isNull() & F.lit(policy == "reject"), "alignment_missing")
    return joined.withColumn("alignment_reason", reason)


def inverted_index(incidence: DataFrame) -> DataFrame:
    """family, token, part, items: the clips of each token, sorted, in lists of bounded length. incidence marks the first
    row of a token in its clip."""
    return chunked(incidence.where("first"), ["family", "token"], "clip_id")


def deficits(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """targets(feature, target, ...) with accepted and deficit."""
    joined = targets.join(counts.select("feature", F.col("count").alias("accepted")), "feature", "left")
    joined = joined.withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    return joined.withColumn("deficit", F.greatest(F.lit(0), F.col("target") - F.col("accepted")))
