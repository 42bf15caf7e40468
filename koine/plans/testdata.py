"""The test tables seen as the engine's own: the same view as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koine.functions.text import collapse_ascii
from koine.functions.tokens import ngrams
from koine.scratch import ship, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """Documents as clips: source as speaker, words as phones, labels as quality and disposition. Dealt anew to all cores
    unless only narrow columns are wanted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    norm = collapse_ascii(F.col("text"))
    toxic, short = F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.col("n_chars") < 20
    phones = F.array_remove(F.split(norm, " "), "")
    return (spread(docs) if deal else docs).join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("clip_id"),
        "doc_id",
        F.col("source").alias("speaker_id"),
        F.concat("lang", F.lit(":"), (F.col("doc_id") % 97).cast("string")).alias("sentence_id"),
        "lang",
        F.col("text").alias("text_raw"),
        norm.alias("text_norm"),
        F.sha2("text", 256).alias("audio_sha256"),
        F.concat(F.col("lang"), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".wav")).alias("normalized_relative_source_path"),
        F.array_join(phones, " ").alias("phonemes"),
        phones.alias("phones"),
        (F.col("n_chars") / 15.0).alias("duration_sec"),
        F.when(F.col("quality") == 1, 80.0).when(F.col("quality") == 0, 40.0).alias("quality_score"),
        F.when(toxic | short, "hard_rejected").otherwise("eligible").alias("disposition"),
        F.when(toxic, "toxic").when(short, "text_length").alias("reject_reason"),
        (F.col("doc_id") % 5).alias("up_votes"),
        (F.col("doc_id") % 3).alias("down_votes"),
    )


CLIPS = r"""clips AS (
  SELECT CAST(doc_id AS VARCHAR) AS clip_id, doc_id, source AS speaker_id, lang || ':' || CAST(doc_id % 97 AS VARCHAR) AS sentence_id, lang, text AS text_raw, text_norm,
    sha256(text) AS audio_sha256, lang || '/' || CAST(doc_id % 50 AS VARCHAR) || '.wav' AS normalized_relative_source_path,
    array_to_string(phones, ' ') AS phonemes, phones, n_chars / 15.0::DOUBLE AS duration_sec,
    CASE quality WHEN 1 THEN 80.0::DOUBLE WHEN 0 THEN 40.0::DOUBLE END AS quality_score,
    CASE WHEN toxic = 1 OR n_chars < 20 THEN 'hard_rejected' ELSE 'eligible' END AS disposition,
    CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 20 THEN 'text_length' END AS reject_reason, doc_id % 5 AS up_votes, doc_id % 3 AS down_votes
  FROM (SELECT *, list_filter(string_split(text_norm, ' '), lambda x: x <> '') AS phones
    FROM (SELECT d.*, quality, toxic, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'), ' ') AS text_norm FROM documents d LEFT JOIN labels USING (doc_id)))
)"""


def with_ngrams(rows: DataFrame) -> DataFrame:
    """Clips with the catalog's list columns; characters of the sentence id stand for morae and labels."""
    return rows.withColumns({"biphones": ngrams(F.col("phones"), 2), "triphones": ngrams(F.col("phones"), 3), "moras": F.split("lang", ""), "fullcontext_labels": F.array("lang", "sentence_id")})


NGRAMS = CLIPS + """, grams AS (
  SELECT *, [phones[i] || '-' || phones[i + 1] FOR i IN range(1, len(phones))] AS biphones,
    [phones[i] || '-' || phones[i + 1] || '-' || phones[i + 2] FOR i IN range(1, len(phones) - 1)] AS triphones,
    string_split(lang, '') AS moras, [lang, sentence_id] AS fullcontext_labels FROM clips
)"""

#: Tokens of clips: phones only, and all five families.
INCIDENCE = CLIPS + ", inc AS (SELECT clip_id, speaker_id, 'phone' AS family, unnest(phones) AS token FROM clips)"
ALL_INCIDENCE = NGRAMS + """, inc AS (
  SELECT clip_id, speaker_id, 'phone' AS family, unnest(phones) AS token FROM grams
  UNION ALL SELECT clip_id, speaker_id, 'biphone', unnest(biphones) FROM grams
  UNION ALL SELECT clip_id, speaker_id, 'triphone', unnest(triphones) FROM grams
  UNION ALL SELECT clip_id, speaker_id, 'mora', unnest(moras) FROM grams
  UNION ALL SELECT clip_id, speaker_id, 'fullcontext', unnest(fullcontext_labels) FROM grams
)"""
