"""Writers: catalogs, plans, logs, training layouts."""

from __future__ import annotations

import csv
import json
import os
import shutil
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koine.functions.text import pipe_safe
from koine.schema import CLIPS, PLAN


def fixed_columns(df: DataFrame, schema) -> DataFrame:
    """The columns of a schema in its order, typed nulls for those that df lacks, others gone."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def recovered(target: str) -> None:
    """After a publication that was cut off between its two renames the folder before is put back."""
    if os.path.exists(f"{target}.old") and not os.path.exists(target):
        os.replace(f"{target}.old", target)


def publish(staging: str, target: str) -> None:
    """Put a finished folder in its place; the one before is kept beside it until that has worked."""
    recovered(target)
    shutil.rmtree(f"{target}.old", ignore_errors=True)
    if os.path.exists(target):
        os.replace(target, f"{target}.old")
    try:
        os.replace(staging, target)
    finally:
        recovered(target)
    shutil.rmtree(f"{target}.old", ignore_errors=True)


def parquet(df: DataFrame, path: str, schema=None) -> None:
    """Write aside and rename: readers see the whole table or the one before."""
    (fixed_columns(df, schema) if schema else df).write.mode("overwrite").parquet(f"{path}.partial")
    publish(f"{path}.partial", path)


def write_json(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    partial = f"{path}.partial"
    Path(partial).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")
    os.replace(partial, path)


def append_jsonl(path: str, rows: Iterable[Mapping]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in rows)


def catalog_bundle(folder: str, tables: Mapping[str, DataFrame], manifest: Mapping | None = None) -> None:
    """All tables, then the manifest: a folder with one is complete."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "manifest.json").unlink(missing_ok=True)
    for name, df in tables.items():
        parquet(df, f"{folder}/{name}.parquet", CLIPS if name == "clips" else None)
    write_json(f"{folder}/manifest.json", {"tables": sorted(tables), **(manifest or {})})


def selection_plan(df: DataFrame, path: str) -> None:
    parquet(df, path, PLAN)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def one_file(df: DataFrame, path: str, column: str = "value") -> None:
    """Lines of a column in the order of df as one file: tasks write their parts beside it on a file system that all
    machines share, and the parts are put together as bytes. Lines must not hold line breaks."""
    parts = f"{path}.parts"
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(Path(parts).absolute().as_uri())
    _together(Path(parts), path)
    shutil.rmtree(parts)


def _together(parts: Path, path: str) -> None:
    with open(f"{path}.partial", "wb") as out:
        for part in sorted(parts.glob("part-*")):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    os.replace(f"{path}.partial", path)


def report_csv(path: str, rows: Sequence[Mapping]) -> None:
    """A small report; an empty file without rows."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        if rows:
            w = csv.DictWriter(f, fieldnames=list(rows[0]))
            w.writeheader()
            w.writerows(rows)


#: Columns of the list of rejected clips.
REJECTS = ("clip_id", "speaker_id", "normalized_relative_source_path", "text_norm", "duration_sec", "reject_reason")


def rejects(clips: DataFrame, path: str) -> None:
    """Rejected clips appended to a folder of CSV files, each with its header, in the order of their ids."""
    rows = clips.where("reject_reason is not null").select(*[c for c in REJECTS if c in clips.columns])
    rows.orderBy("clip_id").write.mode("append").option("header", True).csv(path)


def split_plan(path: str, protocol: str, assigned: DataFrame, ratios: Mapping[str, float], warnings: Sequence[str] = ()) -> None:
    """A plan of splits as JSON beside a table: what is bounded in the one, a row a speaker or clip in the other."""
    kind = "clip" if "clip_id" in assigned.columns else "speaker"
    parquet(assigned, f"{path}.parquet", assigned.schema)
    write_json(f"{path}.json", {"protocol": protocol, "assigns": kind, "ratios": dict(ratios), "warnings": list(warnings)})


def one_line(text):
    """No tabs or line breaks, which part fields and rows."""
    return F.trim(F.regexp_replace(text, r"[\t\r\n]+", " "))


def ljspeech(rows: DataFrame) -> DataFrame:
    """audio_path, normalised and raw text, tab-separated; the raw one falls back on the other. A row without a path or a
    normalised text is an error."""
    bad = rows.where("audio_path is null or trim(coalesce(text_norm, '')) = ''").select("clip_id").limit(5).collect()
    if bad:
        raise ValueError(f"clips without a path or a text: {[r.clip_id for r in bad]}")
    raw = F.coalesce(F.nullif(F.trim("text_raw"), F.lit("")), F.col("text_norm"))
    return rows.orderBy("clip_id").select(F.concat_ws("\t", "audio_path", one_line(F.col("text_norm")), one_line(raw)).alias("value"))


def ljspeech_metadata(rows: DataFrame) -> DataFrame:
    return rows.orderBy("clip_id").select(F.concat_ws("|", "clip_id", pipe_safe(F.coalesce("text_raw", "text_norm")), pipe_safe(F.col("text_norm"))).alias("value"))


def utterances(rows: DataFrame) -> DataFrame:
    """Rows that a trainer can use: with an id and a text, the raw one where the normalised is empty."""
    text = F.coalesce(F.nullif(F.trim("text_norm"), F.lit("")), F.nullif(F.trim("text_raw"), F.lit("")))
    return rows.withColumn("text", text).where("clip_id is not null and text is not null")


def left_out(rows: DataFrame) -> dict[str, int]:
    """How many rows a trainer's list leaves out, and why: for its warnings."""
    missing = F.trim(F.coalesce("text_norm", "text_raw", F.lit(""))) == ""
    n = rows.agg(F.count_if(F.col("clip_id").isNull()).alias("without an id"), F.count_if(missing).alias("without a text")).first().asDict()
    return {k: v for k, v in n.items() if v}


def piper(rows: DataFrame) -> DataFrame:
    """id|text of one speaker, id|speaker|text of several."""
    some = utterances(rows)
    several = some.agg(F.countDistinct("speaker_id")).first()[0] > 1
    middle = [F.col("speaker_id")] if several else []
    return some.orderBy("clip_id").select(F.concat_ws("|", "clip_id", *middle, pipe_safe(F.col("text"))).alias("value"))


def style_bert(rows: DataFrame, language: str = "JP") -> DataFrame:
    """file|speaker|language|text with the speaker beside it, for one list or one a speaker."""
    some = utterances(rows)
    line = F.concat_ws("|", F.concat("clip_id", F.lit(".wav")), "speaker_id", F.lit(language), pipe_safe(F.col("text")))
    return some.orderBy("clip_id").select("speaker_id", line.alias("value"))


def style_bert_packs(rows: DataFrame, folder: str, packaging: str = "single_model", model: str = "model", language: str = "JP", mode: str = "copy") -> dict[str, int]:
    """Data/MODEL/esd.list of all clips, or Data/SPEAKER/esd.list of each speaker's, in the order of their ids; returns the
    clips of each. Rows with a `source` have that file placed at raw/CLIP.wav beside it. Signs that can't be in a name of a
    folder become `_`, and a speaker without an id is `unknown`; speakers whose names become equal share a folder.

    Lists are written over ranges of (pack, clip), so one speaker's may be as long as all of them.
    """
    if packaging not in ("single_model", "per_speaker"):
        raise ValueError(f"packaging must be single_model or per_speaker, not {packaging!r}")
    safe = F.regexp_replace(F.coalesce(F.nullif(F.trim("speaker_id"), F.lit("")), F.lit("unknown")), r"[^\p{L}\p{N}_.-]|^[.]+", "_")
    pack = safe if packaging == "per_speaker" else F.lit(model)
    some = utterances(rows).withColumn("pack", pack)
    line = F.concat_ws("|", F.concat("clip_id", F.lit(".wav")), pipe_safe(F.coalesce("speaker_id", F.lit(""))), pipe_safe(F.lit(language)), pipe_safe(F.col("text")))
    parts = Path(folder).absolute() / "esd.parts"
    lines = some.select("pack", "clip_id", line.alias("value"), F.col("pack").alias("folder")).repartitionByRange("pack", "clip_id").sortWithinPartitions("folder", "clip_id")
    lines.select("value", "folder").write.mode("overwrite").partitionBy("folder").text(parts.as_uri())
    counts = {r.pack: r.n for r in some.groupBy("pack").agg(F.count("*").alias("n")).collect()}  # a row a list
    for name in counts:
        Path(folder, "Data", name, "raw").mkdir(parents=True, exist_ok=True)
    for found in parts.glob("folder=*"):
        _together(found, str(Path(folder, "Data", unquote(found.name.removeprefix("folder=")), "esd.list")))
    shutil.rmtree(parts)
    if "source" in rows.columns:
        place_audio(some.select(F.concat("pack", F.lit("/raw/"), "clip_id").alias("clip_id"), "source"), f"{folder}/Data", mode)
    return counts


def partitioned(rows: DataFrame, path: str, bucket, dry_run: bool = False) -> dict[str, int]:
    """Rows into a folder for each bucket; returns their counts."""
    named = rows.withColumn("bucket", bucket)
    if not dry_run:
        named.write.mode("overwrite").partitionBy("bucket").json(path)
    return {r.bucket: r.n for r in named.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket


def place_audio(rows: DataFrame, folder: str, mode: str = "copy") -> None:
    """Put each row's source file at folder/clip_id.wav on a shared file system: copy, hardlink or symlink."""
    if mode not in ("copy", "hardlink", "symlink"):
        raise ValueError(f"mode must be copy, hardlink or symlink, not {mode!r}")
    os.makedirs(folder, exist_ok=True)

    def put(part):
        for r in part:
            target = f"{folder}/{r.clip_id}.wav"
            if os.path.lexists(target):
                os.unlink(target)
            try:
                {"copy": shutil.copyfile, "hardlink": os.link, "symlink": os.symlink}[mode](r.source, target)
            except OSError:
                if mode == "copy":
                    raise
                shutil.copyfile(r.source, target)

    rows.select("clip_id", "source").foreachPartition(put)


def write_audio(rows: DataFrame, folder: str) -> None:
    """Each row's content at folder/clip_id.wav, on a file system that all machines share; rows without content go."""
    os.makedirs(folder, exist_ok=True)

    def put(part):
        for r in part:
            with open(f"{folder}/{r.clip_id}.wav.partial", "wb") as f:
                f.write(r.content)
            os.replace(f"{folder}/{r.clip_id}.wav.partial", f"{folder}/{r.clip_id}.wav")

    rows.where("content is not null").select("clip_id", "content").foreachPartition(put)


#: Columns of a coverage audit's table.
AUDIT = (
    "feature_family", "feature", "configured_minimum", "configured_desired", "index_candidate_count", "eligible_candidate_count", "eligible_speaker_count", "effective_minimum", "effective_desired",
    "selected_count", "selected_speaker_count", "status", "failure_reason",
)


def coverage_audit(folder: str, audit: DataFrame, plan: DataFrame | None = None, missing: DataFrame | None = None, acoustic: Mapping | None = None) -> dict:
    """An audit's files: coverage-audit.json and .csv, coverage-contributions.jsonl of the plan's selected clips,
    missing-features.json, acoustic-diversity-summary.json if there is one. Tables are streamed, a partition at a time.
    Returns the summary: features by status."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    rows = audit.select(*AUDIT).orderBy("feature_family", "feature")
    summary = {r.status: r.n for r in audit.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row a status
    with open(f"{folder}/coverage-audit.csv", "w", encoding="utf-8", newline="") as table, open(f"{folder}/coverage-audit.json", "w", encoding="utf-8") as f:
        w = csv.writer(table)
        w.writerow(AUDIT)
        f.write('{"summary": ' + json.dumps(summary, sort_keys=True) + ', "features": [')
        for i, r in enumerate(rows.toLocalIterator()):
            w.writerow(r)
            f.write(", " * bool(i) + json.dumps(r.asDict(), ensure_ascii=False))
        f.write("]}\n")
    if plan is not None:
        chosen = plan.where("disposition = 'selected'").orderBy("selection_rank", "clip_id")
        one_file(chosen.select(F.to_json(F.struct("clip_id", F.col("selected_reason").alias("selection_phase"), "positive_contributions", "selection_score")).alias("value")), f"{folder}/coverage-contributions.jsonl")
    if missing is not None:
        with open(f"{folder}/missing-features.json", "w", encoding="utf-8") as f:
            f.write('{"missing_features": [')
            f.writelines(", " * bool(i) + json.dumps(r.asDict(), ensure_ascii=False) for i, r in enumerate(missing.orderBy("feature").toLocalIterator()))
            f.write("]}\n")
    if acoustic is not None:
        write_json(f"{folder}/acoustic-diversity-summary.json", dict(acoustic))
    return summary


def markdown_report(title: str, tables: Mapping[str, Sequence[Mapping]]) -> str:
    out = [f"# {title}"]
    for name, rows in tables.items():
        out += ["", f"## {name}", ""]
        if rows:
            heads = list(rows[0])
            out += ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
            out += ["| " + " | ".join(str(r[h]) for h in heads) + " |" for r in rows]
        else:
            out.append("none")
    return "\n".join(out) + "\n"


def html_report(title: str, tables: Mapping[str, Sequence[Mapping]]) -> str:
    from html import escape

    cell = lambda tag, x: f"<{tag}>{escape(str(x))}</{tag}>"
    parts = [f"<!DOCTYPE html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, rows in tables.items():
        body = "".join("<tr>" + "".join(cell("td", v) for v in r.values()) + "</tr>" for r in rows)
        head = "<tr>" + "".join(cell("th", k) for k in rows[0]) + "</tr>" if rows else ""
        parts.append(f"<h2>{escape(name)}</h2><table>{head}{body}</table>")
    return "".join(parts)
