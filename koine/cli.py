"""Command line: python -m koine.cli COMMAND --config FILE."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from koine import sinks
from koine.functions import backends, text, tokens
from koine.operators import aggregates as agg
from koine.operators import coverage, filters, joins, reports, windows
from koine.plans import build as b
from koine.scratch import cut
from koine.sources import tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("koine").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def _catalog(spark, c):
    return tables.catalog_clips(spark, f"{c.work}/catalog/clips.parquet")


def _scan(spark, c, a):
    rows = b.scan(spark, c)
    stats = tables.tsv_stats(spark, c.tsv)
    whole, lines = tables.clip_tsv(spark, c.tsv), tables.physical_lines(spark, c.tsv)
    n, named = rows.count(), filters.prepare(whole, c.speakers).count() if c.speakers else stats["rows_ok"]
    told = agg.scan_warnings(bool(c.speakers), named, bool(c.axes), n, stats["rows_ok"], lines)
    looked_at = agg.samples_by(rows, "client_id", "path").where("place = 1").orderBy("client_id").limit(15)  # to look at
    samples = [r.asDict() for r in looked_at.select("client_id", "path").collect()]
    _show(stats | {"selected": n, "clients": rows.select("client_id").distinct().count(), "physical_lines": lines, "warnings": told, "samples": samples})


def _analyze(spark, c, a):
    sinks.catalog_bundle(f"{c.work}/catalog", {"clips": b.analyze(spark, c)})


def _split(spark, c, a):
    sinks.parquet(b.plan_split(_catalog(spark, c), c), f"{c.work}/plans/splits.parquet")


def _select(spark, c, a):
    overrides = tables.overrides_jsonl(spark, a.overrides) if a.overrides else None
    sinks.selection_plan(b.select(_catalog(spark, c), spark.read.parquet(f"{c.work}/plans/splits.parquet"), c, overrides), f"{c.work}/plans/selection_plan.parquet")


def _plan(spark, c):
    return spark.read.parquet(f"{c.work}/plans/selection_plan.parquet")


def _partition(spark, c, a):
    rows = filters.partition_filter(tables.metadata_jsonl(spark, a.input, a.schema), a.min_quality, a.max_quality)
    _show(sinks.partitioned(rows, a.output, filters.partition_bucket(a.group_by), a.dry_run))


def _compare(spark, c, a):
    sides = reports.compare_ids(tables.selected_ids(spark, a.left), tables.selected_ids(spark, a.right))
    _show({r.side: r.n for r in sides.groupBy("side").agg(F.count("*").alias("n")).collect()})


def _suggest(spark, c, a):
    rows = spark.read.json(a.input)
    pairs = rows.select(F.explode(tokens.proportional_pairs(tokens.split_tokens(F.col("aligned")), tokens.split_tokens(F.col("expected")))).alias("p"))
    votes = pairs.groupBy("p.src", "p.dst").agg(F.count("*").alias("votes"))
    found = windows.vote_winners(votes)
    if a.base:
        base = spark.createDataFrame(sorted(tables.token_map(a.base).items()), "src string, dst string")
        found = windows.merge_suggestions(base, found, a.overwrite)
    _show([r.asDict() for r in found.orderBy("src").collect()])


def _normalize(spark, c, a):
    df = spark.createDataFrame([(a.text,)], "t string")
    print(df.select(text.normalize_for_tts(F.col("t"))).first()[0])


def _report(spark, c, a):
    clips = _catalog(spark, c)
    found = {"rejections": [r.asDict() for r in reports.rejection_summary(clips).orderBy("reason").collect()]}
    Path(a.output).write_text(sinks.html_report("Catalog", found) if a.output.endswith(".html") else sinks.markdown_report("Catalog", found), encoding="utf-8")


def _index(spark, c, a):
    prior = tables.index_jsonl(spark, a.base) if a.base else None
    sinks.jsonl(b.coverage_index(spark, c, prior), a.output)


def _coverage(spark, c, a):
    """targets of the configuration against what the catalog has, and the batch to analyse next."""
    index = tables.index_jsonl(spark, a.input)
    targets = spark.createDataFrame(coverage.target_rows(c.targets), "feature string, minimum long, desired long, required boolean, weight double")
    done = spark.createDataFrame([], "clip_id string")
    counts = agg.coverage_counts(index.join(done, "clip_id", "left_semi"))
    if Path(f"{c.work}/catalog/clips.parquet").exists():
        clips = _catalog(spark, c)
        done = clips.select("clip_id")
        counts = agg.coverage_counts(index.join(clips.where(filters.counted(F.col("disposition"))), "clip_id", "left_semi"))
    stats = spark.createDataFrame([], "speaker_id string, attempts long, passes long")
    short = joins.deficits(targets.withColumnRenamed("desired", "target"), counts)
    batch = coverage.plan_batch(index, targets, counts, done, stats)
    _show({"deficits": [r.asDict() for r in short.where("deficit > 0").orderBy("feature").collect()], "batch": [r.asDict() for r in batch.orderBy("rank").collect()]})


def _manifest(spark, c, a):
    if a.input:
        rows = tables.textgrid_phones(spark, a.input).select(F.col("path").alias("source_path"), F.array_join(tokens.substitute(F.col("phones"), tables.token_map(a.base) if a.base else {}), " ").alias("phonemes"))
    else:
        rows = _catalog(spark, c).select(F.col("normalized_relative_source_path").alias("source_path"), "phonemes")
    sinks.jsonl(rows, a.output)


def _export(spark, c, a):
    rows = joins.plan_with_clips(_plan(spark, c).where("disposition = 'selected'"), _catalog(spark, c)).withColumn("audio_path", F.concat("clip_id", F.lit(".wav")))
    if a.packaging:
        return _show(sinks.style_bert_packs(rows, a.output, a.packaging))
    layout = {"piper": sinks.piper, "style-bert": sinks.style_bert, "ljspeech": sinks.ljspeech, "ljspeech-metadata": sinks.ljspeech_metadata}[a.layout]
    sinks.one_file(layout(rows), a.output)


def _targets(spark, c):
    return spark.createDataFrame(coverage.target_rows(c.targets), "feature string, minimum long, desired long, required boolean, weight double")


def _coverage_run(spark, c, a):
    """Batches of the index are planned and analysed until the targets are met or nothing helps; the state is kept."""
    index, found = tables.index_jsonl(spark, a.input).cache(), f"{c.work}/coverage/clips.parquet"
    Path(c.work, "coverage").mkdir(parents=True, exist_ok=True)

    def analyze(ids):
        rows = cut(b.analyze_some(spark, c, index, ids), "batch")
        rows.write.mode("append").parquet(found)
        return rows.select("clip_id", (F.col("disposition") == "eligible").alias("passed"))

    limits = coverage.LoopLimits(a.max_iterations, a.max_clips, a.max_hours)
    state = coverage.run_loop(index, _targets(spark, c), analyze, f"{c.work}/coverage/state.json", limits, dry_run=a.dry_run)
    _show({"stop": state.stop, "iterations": state.iteration, "analyzed": len(state.analyzed), "accepted": len(state.accepted), "seconds": state.seconds})


def _coverage_report(spark, c, a):
    """Where each target stands in a loop's state."""
    index, state = tables.index_jsonl(spark, a.input), coverage.LoopState(**json.loads(Path(c.work, "coverage", "state.json").read_text()))
    ids = lambda names: spark.createDataFrame([(x,) for x in names], "clip_id string")
    rows = coverage.standing(index, _targets(spark, c), ids(state.accepted), ids(state.analyzed), sum(state.passes.values()) / max(1, sum(state.attempts.values())))
    kept = rows.orderBy("feature").collect()  # a row a target
    _show({"stop": state.stop, "features": [r.asDict() for r in kept], "top_reasons": coverage.top_deficits(kept)})
    if a.output:
        sinks.report_csv(a.output, [r.asDict() for r in kept])


def _phonemize(spark, c, a):
    df = spark.createDataFrame([(a.text,)], "t string")
    print(df.select(backends.phonemes(text.normalize_for_tts(F.col("t")), c.reading or "words")).first()[0] or "")


def _secondary(spark, c, a):
    """Finished recordings of a folder through the chain again; gated again, written beside their list."""
    meta = tables.metadata_jsonl(spark, f"{a.input}/metadata.jsonl", "clip_id string, text_norm string, quality_score double")
    files = tables.audio_files(spark, f"{a.input}/wavs").select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("clip_id"), "content")
    done = cut(b.secondary(meta.join(files, "clip_id"), c.rescue or c.chain, b.quality.Gate().merged(overrides=c.gate)), "secondary")
    Path(a.output).mkdir(parents=True, exist_ok=True)
    sinks.write_audio(done.where("reject_reason is null"), f"{a.output}/wavs")
    sinks.one_file(done.drop("content").orderBy("clip_id").select(F.to_json(F.struct("*")).alias("value")), f"{a.output}/metadata.jsonl")
    _show({r.reason: r.n for r in done.groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n")).collect()})


def _to_tsv(spark, c, a):
    """A metadata.jsonl as a clip table."""
    meta = tables.metadata_jsonl(spark, a.input, "clip_id string, audio_path string, text_raw string, text_norm string, speaker_id string")
    told = sinks.one_line(F.coalesce("text_raw", "text_norm"))
    line = F.concat_ws("\t", F.coalesce("speaker_id", F.lit("unknown")), F.regexp_extract("audio_path", "[^/]+$", 0), told).alias("value")
    head = spark.createDataFrame([("client_id\tpath\tsentence", -1)], "value string, n long")
    rows = meta.orderBy("clip_id").select(line, F.monotonically_increasing_id().alias("n"))
    sinks.one_file(head.unionByName(rows).orderBy("n").select("value"), a.output)


def _preprocess(spark, c, a):
    """Analysis of all clips with the list of what was rejected, without a selection."""
    clips = cut(b.analyze(spark, c), "preprocess")
    sinks.rejects(clips, f"{c.work}/rejects")
    usable = clips.where("disposition = 'eligible'").withColumn("audio_path", F.concat("clip_id", F.lit(".wav")))
    Path(c.work).mkdir(parents=True, exist_ok=True)
    sinks.one_file(sinks.ljspeech(usable), f"{c.work}/ljspeech.tsv")
    rejected = clips.where("reject_reason is not null")
    samples: dict[str, list[str]] = {}
    for r in agg.samples_by(rejected, "reject_reason", "clip_id", ["text_norm"]).orderBy("reject_reason", "place").collect():  # five a reason
        samples.setdefault(r.reject_reason, []).append(f"{r.clip_id}: {r.text_norm}")
    _show({"samples": samples, "rejected": {r.reason: r.clips for r in reports.rejection_summary(clips).collect()}, "usable": usable.count(), "settings": c.hash()})


def _benchmark(spark, c, a):
    """Seconds of scoring, selecting and counting over the catalog, the best of three."""
    clips, took = _catalog(spark, c).cache(), {}
    splits = clips.select("clip_id", F.lit("train").alias("split"))
    jobs = {
        "feature_counts": lambda: agg.feature_counts(agg.incidence(clips, agg.catalog_families())), "duplicate_groups": lambda: agg.duplicate_groups(clips),
        "select": lambda: b.select(clips, splits, c),
    }
    for name, job in jobs.items():
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    _show(took)


COMMANDS = {
    "coverage-run": _coverage_run,
    "coverage-report": _coverage_report,
    "phonemize": _phonemize,
    "secondary": _secondary,
    "metadata-jsonl-to-validated-tsv": _to_tsv,
    "preprocess": _preprocess,
    "benchmark-selection": _benchmark,
    "coverage-index": _index,
    "coverage-plan": _coverage,
    "phoneme-manifest": _manifest,
    "export-trainer": _export,
    "scan": _scan,
    "analyze": _analyze,
    "plan-split": _split,
    "select": _select,
    "materialize": lambda s, c, a: b.materialize(_catalog(s, c), _plan(s, c), c),
    "audit": lambda s, c, a: _show(b.audit(_catalog(s, c), _plan(s, c), c)),
    "build": lambda s, c, a: _show(b.build(s, c, a.force)),
    "compare-runs": _compare,
    "dataset-partition": _partition,
    "suggest-token-map": _suggest,
    "text-normalize": _normalize,
    "report": _report,
    "browse": lambda s, c, a: _show([r.asDict() for r in filters.browse(_catalog(s, c), contains=a.contains, limit=20).select("clip_id", "speaker_id", "text_norm", "total").collect()]),
    "check-plan": lambda s, c, a: _show({"rows": joins.plan_with_clips(_plan(s, c), _catalog(s, c)).count()}),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="koine", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--config")
    p.add_argument("--force", action="store_true")
    p.add_argument("--overrides")
    p.add_argument("--left")
    p.add_argument("--right")
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--schema", default="clip_id string, quality_tier string, split string, quality_score double, audio_path string")
    p.add_argument("--group-by", default="split")
    p.add_argument("--min-quality", type=float)
    p.add_argument("--max-quality", type=float)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--base")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--contains")
    p.add_argument("--text", default="")
    p.add_argument("--layout", default="piper")
    p.add_argument("--packaging", choices=("single_model", "per_speaker"))
    p.add_argument("--max-iterations", type=int, default=50)
    p.add_argument("--max-clips", type=int, default=10_000)
    p.add_argument("--max-hours", type=float, default=100.0)
    a = p.parse_args(argv)
    config = b.Config.from_file(a.config) if a.config else b.Config()
    COMMANDS[a.command](_session(), config, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
