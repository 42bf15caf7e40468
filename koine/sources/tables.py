"""Readers of clip tables, catalogs, manifests and logs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from koine.schema import CLIPS, INDEX, PLAN
from koine.scratch import numbered

#: Columns that a clip needs, what an override may ask for, marks of silence.
REQUIRED = ("client_id", "path", "sentence")
ACTIONS = ("force_include", "force_exclude", "hard_reject", "return_to_reserve")
SILENT = ("", "sp", "sil", "eps", "silence", "<eps>", "<sil>", "<unk>")


def clip_tsv(spark: SparkSession, path: str, skip_incomplete: bool = True) -> DataFrame:
    """A tab-separated clip table: byte-order mark, quoted fields with line breaks and doubled quotes, any length.

    All columns are strings; `accent` is read as `accents`; row_index is the place in the file. A file is read by one
    task, as a quoted line break can't be found from the middle. Rows without a required field go, or raise.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = raw.option("maxCharsPerColumn", -1).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns]).withColumnRenamed("accent", "accents")
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    rows = rows.withColumn("row_index", F.monotonically_increasing_id())
    complete = _complete()
    if not skip_incomplete and (bad := rows.where(~complete).select("row_index").limit(1).collect()):
        raise ValueError(f"{path}: row {bad[0].row_index} lacks one of {REQUIRED}")
    return rows.where(complete)


def _complete() -> Column:
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & (F.coalesce(F.trim(c), F.lit("")) != "")
    return ok


def tsv_stats(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows in all, skipped and usable, in one pass."""
    raw = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    total, ok = raw.agg(F.count("*"), F.count_if(_complete())).first()
    return {"rows_total": total, "rows_skipped": total - ok, "rows_ok": ok}


def physical_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def catalog_clips(spark: SparkSession, path: str) -> DataFrame:
    """The clips of a catalog in the fixed columns; those a file lacks are null."""
    return spark.read.schema(CLIPS).parquet(path)


def catalog_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a catalog folder that its manifest names."""
    names = json.loads((Path(folder) / "manifest.json").read_text())["tables"]
    return {n: catalog_clips(spark, f"{folder}/{n}.parquet") if n == "clips" else spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def index_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).option("mode", "FAILFAST").json(path)


def metadata_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that hold an object; blank lines and other values are skipped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, line of text files, numbered from 1 in the order of their paths and lines; read in splits, whatever their size."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("line"))
    return numbered(lines.withColumn("at", F.monotonically_increasing_id()), ["file_path", "file_block_start", "at"], "n").select("n", "line")


def overrides_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, action, reason; lines that are blank or begin with # are skipped, the last of a clip wins. A bad line
    raises with its number."""
    lines = numbered_lines(spark, path).where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    rows = lines.select("n", F.from_json("line", "clip_id string, action string, reason string").alias("r")).select("n", "r.*")
    bad = rows.where(F.col("clip_id").isNull() | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).orderBy("n").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: line {bad[0].n} is no override")
    return last_wins(rows, "clip_id", "n")


def phoneme_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source_path, phonemes; the last of a path wins; a line without either raises."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    rows = lines.select("n", F.from_json("line", "source_path string, phonemes string").alias("r")).select("n", "r.*")
    bad = rows.where("source_path is null or phonemes is null").orderBy("n").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: line {bad[0].n} has no source_path and phonemes")
    return last_wins(rows, "source_path", "n")


def split_plan(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A plan of splits that sinks.split_plan wrote: its settings and the table of what it assigns."""
    return json.loads(Path(f"{path}.json").read_text(encoding="utf-8")), spark.read.parquet(f"{path}.parquet")


def run_manifest(folder: str) -> dict:
    """The manifest of a run: its own, else the catalog's; an empty one where there is none."""
    for name in ("run_manifest.json", "catalog/manifest.json"):
        if (path := Path(folder) / name).exists():
            return json.loads(path.read_text(encoding="utf-8"))
    return {}


def progress_after(events: DataFrame, after: int, most: int = 500) -> DataFrame:
    """The next events of a progress log: those with an id beyond `after`, oldest first, a page of them."""
    return events.where(F.col("id") > after).orderBy("id").limit(most)


def newest_first(jobs: DataFrame, offset: int = 0, most: int = 50, by: str = "created_at", key: str = "job_id") -> DataFrame:
    """A page of jobs, the newest first."""
    return jobs.orderBy(F.desc(by), F.desc(key)).offset(offset).limit(most)


def selected_ids(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id of what a run selected: its plan, or its metadata."""
    plan = Path(folder) / "plans" / "selection_plan.parquet"
    if plan.exists():
        return spark.read.schema(PLAN).parquet(str(plan)).where("disposition = 'selected'").select("clip_id")
    rows = metadata_jsonl(spark, f"{folder}/metadata.jsonl", "clip_id string, utt_id string")
    return rows.select(F.coalesce("clip_id", "utt_id").alias("clip_id")).where("clip_id is not null")


def textgrid_phones(spark: SparkSession, path: str) -> DataFrame:
    """path, phones of TextGrid files: the marks of the first interval tier whose name has `phones`, without silences."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    tiers = F.filter(F.split("value", r"item\s*\[\d+\]:"), lambda t: t.rlike(r'class\s*=\s*"IntervalTier"') & t.rlike(r'(?i)name\s*=\s*"[^"]*phones[^"]*"'))
    marks = F.regexp_extract_all(F.get(tiers, F.lit(0)), F.lit(r'text\s*=\s*"([^"]*)"'), 1)
    kept = F.filter(F.transform(marks, lambda m: F.trim(m)), lambda m: ~F.lower(m).isin(*SILENT))
    return files.select("path", F.coalesce(kept, F.array().cast("array<string>")).alias("phones"))


def ctm_tokens(spark: SparkSession, path: str) -> DataFrame:
    """path, tokens of CTM files in the order of their lines: the fifth field of lines with eight or more."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("lines"))
    fields = F.filter(F.transform("lines", lambda x: F.split(F.trim(x), r"\s+")), lambda f: F.size(f) >= 8)
    return lines.select("path", F.transform(fields, lambda f: f[4]).alias("tokens"))


def audio_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path, length, content and its sha256 of recordings; without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("audio_sha256")) if content else files.select("path", "length")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """relative, name, recording (a URI) and audio_sha256 of the files below a folder. Contents are hashed where they are read; what
    needs them later reads them by their URI, so they go through no exchange."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = audio_files(spark, folder)
    return files.select(F.substring("path", len(root) + 2, 1 << 20).alias("relative"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("path").alias("recording"), "audio_sha256")


def with_recordings(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows(path, ...) with recording and audio_sha256, null where there is none: the file at the row's path below the folder, or else
    the only file there of its name. Of two files of one name in two folders neither is taken for the other."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^(\\./|/)+", "")
    exact = rows.withColumn("__at", path).join(files.select(F.col("relative").alias("__at"), "recording", "audio_sha256"), "__at", "left")
    alone = files.groupBy("name").agg(F.count("*").alias("n"), F.first("recording").alias("__recording"), F.first("audio_sha256").alias("__sha")).where("n = 1")
    missing = F.when(F.col("recording").isNull(), F.regexp_extract("__at", "[^/]+$", 0))
    out = exact.withColumn("__name", missing).join(alone.select(F.col("name").alias("__name"), "__recording", "__sha"), "__name", "left")
    return out.select(*rows.columns, F.coalesce("recording", "__recording").alias("recording"), F.coalesce("audio_sha256", "__sha").alias("audio_sha256"))


def missing_audio(clips: DataFrame, files: DataFrame, most: int = 5000) -> DataFrame:
    """Paths among the first rows that no file has: a look at a sample, as its report says."""
    have = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name")).distinct()
    return clips.orderBy("path").limit(most).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name")).join(have, "name", "left_anti").select("path")


def token_map(path: str) -> dict[str, str]:
    """A token map: `key: value` lines, a null value maps to nothing. Comments and quotes as in YAML."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.partition(": ") if ": " in line else line.partition(":")
        value = value.split(" #")[0].strip().strip("'\"")
        out[key.strip().strip("'\"")] = "" if value in ("null", "~") else value
    return out
