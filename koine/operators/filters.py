"""Row filters over clip tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_speakers(clips: DataFrame, speakers: Sequence[str], column: str = "client_id") -> DataFrame:
    """Clips of the speakers named; all where none is."""
    wanted = sorted({s.strip() for s in speakers if s.strip()})
    return clips.where(F.trim(column).isin(wanted)) if wanted else clips


def allowed(column: Column, values: Sequence[str]) -> Column:
    """Whether a cell is among the values, in any case; an empty or missing one passes only if "" is among them."""
    if not values:
        return F.lit(True)
    folded = sorted({v.strip().lower() for v in values})
    return F.coalesce(F.lower(F.trim(column)), F.lit("")).isin(folded)


def by_metadata(clips: DataFrame, axes: Mapping[str, Sequence[str]], min_up_votes: int | None = None, max_down_votes: int | None = None) -> DataFrame:
    """Clips that every axis allows and whose votes are within bounds; votes that are no number fail."""
    for name, values in axes.items():
        clips = clips.where(allowed(F.col(name), values))
    votes = lambda c: F.expr(f"try_cast(trim(cast({c} as string)) as int)")
    if min_up_votes is not None:
        clips = clips.where(votes("up_votes") >= min_up_votes)
    if max_down_votes is not None:
        clips = clips.where(votes("down_votes") <= max_down_votes)
    return clips


def merge_speakers(clips: DataFrame, speaker: str | None) -> DataFrame:
    return clips.withColumn("client_id", F.lit(speaker)) if speaker else clips


def prepare(clips: DataFrame, speakers=(), axes=None, min_up_votes=None, max_down_votes=None, most: int | None = None, merge_into: str | None = None) -> DataFrame:
    """Speakers, metadata, order by path, head, merged speaker: one lazy plan."""
    rows = by_metadata(by_speakers(clips, speakers), axes or {}, min_up_votes, max_down_votes)
    if most is not None:
        rows = rows.orderBy("path").limit(most)
    return merge_speakers(rows, merge_into)


def stage_counts(clips: DataFrame, speakers=(), axes=None, min_up_votes=None, max_down_votes=None) -> DataFrame:
    """Rows before, after the speakers' filter and after the metadata's, in one pass."""
    flag = clips.withColumn("__all", F.lit(1))
    named = by_speakers(flag, speakers)
    both = by_metadata(named, axes or {}, min_up_votes, max_down_votes)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(flag, "rows_total").crossJoin(n(named, "rows_speaker")).crossJoin(n(both, "rows_final"))  # three single rows


# Which dispositions count where: four sets that differ.
def splittable(disposition: Column) -> Column:
    return F.coalesce(disposition, F.lit("eligible")).isin("eligible", "selected")


def selectable(disposition: Column) -> Column:
    return F.coalesce(disposition, F.lit("")).isin("eligible", "selected", "reserve", "")


def counted(disposition: Column) -> Column:
    return F.coalesce(disposition.isin("eligible", "selected"), F.lit(False))


def accepted(disposition: Column) -> Column:
    return F.coalesce(disposition.isin("eligible", "selected", "reserve"), F.lit(False))


def browse(clips: DataFrame, equal: Mapping[str, str] | None = None, contains: str | None = None, columns=("clip_id", "text_norm", "speaker_id"), offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the catalog in the order of clip_id, each row with the number of matches."""
    for name, value in (equal or {}).items():
        clips = clips.where(F.col(name) == value)
    if contains:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.col(c), F.lit(contains)), F.lit(False))
        clips = clips.where(hit)
    total = clips.agg(F.count("*").alias("total"))
    return clips.orderBy("clip_id").offset(offset).limit(limit).crossJoin(total)  # one row


def useful(index: DataFrame, deficits: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Indexed clips that aren't analysed or invalid and have a feature that is still short."""
    short = deficits.where("deficit > 0").select(F.col("feature").alias("__f"))
    open_ = index.where(~F.coalesce("invalidated", F.lit(False))).join(analyzed.select("clip_id"), "clip_id", "left_anti")
    helping = open_.select("clip_id", F.explode("feature_keys").alias("__f")).join(short, "__f", "left_semi").select("clip_id").distinct()
    return open_.join(helping, "clip_id", "left_semi")


def partition_filter(rows: DataFrame, min_quality=None, max_quality=None, tiers: Sequence[str] = ()) -> DataFrame:
    """Bounds on quality, which a missing one fails, and a set of tiers, where a missing one is UNKNOWN."""
    if min_quality is not None:
        rows = rows.where(F.coalesce(F.col("quality_score") >= min_quality, F.lit(False)))
    if max_quality is not None:
        rows = rows.where(F.coalesce(F.col("quality_score") <= max_quality, F.lit(False)))
    return rows.where(F.coalesce(F.upper("quality_tier"), F.lit("UNKNOWN")).isin([t.upper() for t in tiers])) if tiers else rows


def partition_bucket(group_by: str) -> Column:
    """Name of the bucket by quality_tier, split or both."""
    tier, split = F.coalesce(F.upper("quality_tier"), F.lit("UNKNOWN")), F.coalesce("split", F.lit("unknown"))
    kinds = {"quality_tier": tier, "split": split, "split__tier": F.concat_ws("__", split, tier)}
    if group_by not in kinds:
        raise ValueError(f"group_by must be one of {sorted(kinds)}, not {group_by!r}")
    return kinds[group_by]
