"""Schemas of the tables the engine keeps."""

from pyspark.sql import types as T

_S, _L, _D, _A, _I = T.StringType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType()), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: One row for each analysed clip.
CLIPS = _schema(
    clip_id=_S, source_release=_S, source_row_index=_L, normalized_relative_source_path=_S, audio_sha256=_S, text_raw=_S, text_norm=_S, speaker_id=_S, sentence_id=_S,
    duration_sec=_D, disposition=_S, reject_reason=_S, phonemes=_S, biphones=_A, triphones=_A, moras=_A, fullcontext_labels=_A, feature_source=_S, analysis_warnings=_A,
    quality_score=_D, estimated_snr_db=_D, silence_ratio=_D, pipeline_hash=_S, audio_cache_rel_path=_S, split=_S, duplicate_group_ids=_S, selection_rank=_L, selection_utility=_D,
    override_flags=_S, analyzed_at=_S,
)
FEATURE_COUNTS = _schema(feature_type=_S, feature=_S, count=_L, speaker_count=_L, utterance_count=_L)
SPEAKER_STATS = _schema(speaker_id=_S, n_clips=_L, n_eligible=_L, duration_sec_sum=_D, mean_quality=_D)
DUPLICATE_GROUPS = _schema(group_id=_S, kind=_S, key=_S, size=_L)
DUPLICATE_MEMBERS = _schema(group_id=_S, kind=_S, size=_L, part=_L, items=_A)
CHEAP_QUALITY = _schema(decode_ok=T.BooleanType(), peak=_D, rms=_D, clipping_ratio=_D, silence_ratio=_D)
#: One row for each clip of the coverage index.
INDEX = _schema(
    clip_id=_S, source_path=_S, source_row_index=_L, client_id=_S, sentence=_S, normalized_text=_S, duration_sec=_D, up_votes=_L, down_votes=_L, audio_sha256=_S,
    feature_keys=_A, cheap_quality=CHEAP_QUALITY, invalidated=T.BooleanType(),
)
PLAN = _schema(
    clip_id=_S, disposition=_S, split=_S, selection_score=_D, selection_rank=_L, positive_contributions=_S, penalties=_S, selected_reason=_S, reserve_reason=_S
)
OVERRIDES = _schema(clip_id=_S, action=_S, reason=_S)
