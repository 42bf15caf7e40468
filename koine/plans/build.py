"""The build of a dataset: scan, analyse, plan splits, select, materialise, audit. Each stage leaves an artefact that a
later build takes up if its settings are the same."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koine import sinks
from koine.audio import align, metrics, steps
from koine.functions import backends, features, quality, text, tokens
from koine.operators import aggregates as agg
from koine.operators import filters, joins, reports, selection, split
from koine.operators.coverage import target_rows
from koine.schema import CLIPS, INDEX
from koine.scratch import cut, ship
from koine.sources import tables


#: Version of the settings.
SCHEMA_VERSION = 1
#: Settings that the analysis of a clip depends on: with the same ones a clip is taken from the catalog before.
ANALYSIS = ("release", "locale", "text_length", "japanese_ratio", "chain", "rescue", "early", "gate", "reading", "asr", "aligner", "alignments", "alignment_policy")


@dataclass
class Config:
    """Settings of a build; from_file reads JSON, or YAML where a parser is installed."""

    tsv: str = ""
    audio: str = ""
    work: str = "work"
    output: str = "output"
    release: str = "local"
    locale: str = ""
    text_length: tuple[int, int] = (2, 200)
    japanese_ratio: float | None = None
    speakers: list[str] = field(default_factory=list)
    axes: dict[str, list[str]] = field(default_factory=dict)
    min_up_votes: int | None = None
    max_down_votes: int | None = None
    chain: list[dict] = field(default_factory=list)
    rescue: list[dict] = field(default_factory=list)
    early: dict[str, bool] = field(default_factory=dict)
    reading: str = ""
    asr: dict = field(default_factory=dict)
    aligner: dict = field(default_factory=dict)
    alignments: str = ""
    alignment_policy: str = "skip"
    exchanges: list[str] = field(default_factory=lambda: ["1v1"])
    families: list[str] = field(default_factory=lambda: ["phone", "biphone", "triphone"])
    split_families: list[str] = field(default_factory=lambda: ["phone"])
    family_weights: dict[str, float] = field(default_factory=dict)
    family_taus: dict[str, float] = field(default_factory=dict)
    coverage_policy: str = "warn"
    schema_version: int = 1
    gate: dict = field(default_factory=dict)
    targets: dict = field(default_factory=dict)
    hours: float = 1.0
    alpha: float = 0.5
    protocol: str = "unseen_speaker"
    ratios: dict[str, float] = field(default_factory=lambda: {"train": 0.9, "val": 0.05, "test": 0.05})
    limits: dict = field(default_factory=dict)
    leakage: dict[str, str] = field(default_factory=lambda: {"speaker": "forbid", "audio": "forbid", "sentence": "allow", "text": "forbid_for_test"})
    seed: int = 0

    @classmethod
    def from_file(cls, path: str) -> Config:
        raw = Path(path).read_text(encoding="utf-8")
        try:
            value = json.loads(raw)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path} is no JSON, and no YAML parser is installed") from e
            value = yaml.safe_load(raw)
        unknown = set(value) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        return cls(**value)

    def hash(self, *names: str) -> str:
        picked = {k: v for k, v in asdict(self).items() if not names or k in names}
        return hashlib.sha256(json.dumps(picked, sort_keys=True).encode()).hexdigest()[:16]

    def lint(self) -> list[str]:
        """Settings that won't do what they seem to."""
        out = []
        if self.schema_version != SCHEMA_VERSION:
            out.append(f"settings of version {self.schema_version} are read as version {SCHEMA_VERSION}")
        if not self.chain:
            out.append("no processing steps: recordings are used as they are")
        if self.coverage_policy not in ("fail", "warn", "best_effort"):
            raise ValueError(f"coverage_policy must be fail, warn or best_effort, not {self.coverage_policy!r}")
        if abs(sum(self.ratios.values()) - 1) > 1e-6:
            out.append("split ratios don't add up to 1")
        return out


def clip_id(release, path, row_index, audio, raw):
    """Identity of a clip: sha256 of release, path, row, recording and text, put together without separators."""
    return F.sha2(F.concat(release, path, row_index.cast("string"), F.coalesce(audio, F.lit("")), F.coalesce(raw, F.lit(""))), 256)


def scan(spark: SparkSession, c: Config) -> DataFrame:
    ship(spark)
    rows = tables.clip_tsv(spark, c.tsv)
    return filters.prepare(rows, c.speakers, c.axes, c.min_up_votes, c.max_down_votes)


def analyze(spark: SparkSession, c: Config, prior: DataFrame | None = None) -> DataFrame:
    """The catalog's clips. Rows that `prior` settled under the same settings, at the same place and with the same text,
    are taken from it. Reasons that need only text come first; only clips without one are decoded, once each."""
    rows = scan(spark, c)
    if prior is None:
        return _analyzed(spark, c, rows)
    settled = prior.withColumnsRenamed({"normalized_relative_source_path": "path", "source_row_index": "row_index"})
    known = cut(joins.reusable(rows.withColumn("text_raw", F.col("sentence")), settled, c.hash(*ANALYSIS)), "known")
    kept = prior.join(known.where("reuse").select(F.col("prior_clip_id").alias("clip_id")), "clip_id", "left_semi")
    return sinks.fixed_columns(kept, CLIPS).unionByName(_analyzed(spark, c, known.where("not reuse").drop("reuse", "prior_clip_id", "text_raw")))


def _analyzed(spark: SparkSession, c: Config, rows: DataFrame) -> DataFrame:
    gate = quality.Gate().merged(overrides=c.gate)
    rows = rows.withColumn("text_norm", text.normalize_for_tts(F.col("sentence")))
    locale = F.col("locale") if "locale" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("text_reason", text.text_reason(F.col("text_norm"), locale, c.locale, *c.text_length, c.japanese_ratio))
    joined = tables.with_recordings(rows, tables.recordings(spark, c.audio))
    if c.alignments:  # all joins come before recordings are read
        joined = joins.manifest_phonemes(joined.withColumn("source_path", F.col("path")), tables.phoneme_manifest(spark, c.alignments), c.alignment_policy)
    early = quality.EarlyGate(**c.early).reason(gate) if c.early else None
    morae = text.morae(F.col("text_norm"))
    joined = joined.withColumns({"usable": F.when(F.col("text_reason").isNull(), F.col("recording")), "letters": F.length("text_norm")})
    joined = steps.processed(joined, "usable", c.chain, letters="letters", early=early, keep=bool(c.rescue or c.asr or c.aligner))
    judged = lambda: quality.gate_reason(F.col("processed.m"), F.length("text_norm"), F.size(morae) if gate.min_sec_per_mora else None, gate)
    if c.rescue:  # what the gate turns down gets a second chain and is judged by that
        failed = judged().isNotNull() & F.col("processed.content").isNotNull()
        joined = joined.withColumn("failed", F.when(failed, F.col("processed.content")))
        joined = steps.processed(joined, "failed", c.rescue, "again", keep=bool(c.asr or c.aligner)).withColumn("processed", F.when(F.col("failed").isNotNull(), F.col("again")).otherwise(F.col("processed")))
    joined = joined.withColumn("m", F.col("processed.m"))
    if c.asr:
        joined = joined.withColumn("heard", _heard(c, F.col("processed.content"), F.col("text_norm")))
    reason = F.coalesce(
        F.col("text_reason"), F.when(F.col("recording").isNull(), "audio_missing"), F.col("processed.reason"), F.when(F.col("m.duration_sec").isNull(), "audio_error"), judged(),
        _asr_reason(c, F.col("processed.content"), F.col("text_norm")),
    )
    if c.asr.get("sync_text") or c.asr.get("hypothesis_phonemes"):
        joined, reason = _written_back(c, joined.withColumn("reason", reason))
    read = F.col("read_as") if c.asr.get("hypothesis_phonemes") or c.asr.get("sync_text") else F.col("text_norm")
    spoken = tokens.split_tokens(backends.phonemes(read, c.reading)) if c.reading else tokens.split_tokens(F.lower(read))
    if c.alignments:
        spoken, reason = F.when(F.col("aligned_phonemes").isNotNull(), tokens.split_tokens(F.col("aligned_phonemes"))).otherwise(spoken), F.coalesce(reason, F.col("alignment_reason"))
    source = F.when(F.col("aligned_phonemes").isNotNull(), "alignment").otherwise(c.reading or "words") if c.alignments else F.lit(c.reading or "words")
    joined = joined.withColumn("spoken", spoken).withColumn("reason", reason)
    phones = F.filter("spoken", lambda t: ~tokens.is_excluded(t))
    if c.asr.get("hypothesis_phonemes"):
        joined = joined.withColumn("reason", F.coalesce("reason", F.when((F.coalesce(F.size("spoken"), F.lit(-1)) <= 0), "asr_hypothesis_phonemize_failed")))
    if c.aligner:
        joined = _aligned(c, joined.withColumn("phones", phones))
    out = joined.select(
        clip_id(F.lit(c.release), F.col("path"), F.col("row_index"), F.col("audio_sha256"), F.col("sentence")).alias("clip_id"),
        F.lit(c.release).alias("source_release"), F.col("row_index").alias("source_row_index"), F.replace("path", F.lit("\\"), F.lit("/")).alias("normalized_relative_source_path"),
        "audio_sha256", F.col("sentence").alias("text_raw"), "text_norm", F.col("client_id").alias("speaker_id"),
        (F.col("sentence_id") if "sentence_id" in rows.columns else F.lit(None).cast("string")).alias("sentence_id"),
        F.col("m.duration_sec").alias("duration_sec"), F.when(F.col("reason").isNull(), "eligible").otherwise("hard_rejected").alias("disposition"), F.col("reason").alias("reject_reason"),
        F.array_join("spoken", " ").alias("phonemes"), tokens.ngrams(phones, 2).alias("biphones"), tokens.ngrams(phones, 3).alias("triphones"), morae.alias("moras"), source.alias("feature_source"),
        quality.quality_score(F.col("m.snr_db"), F.col("m.silence_ratio"), F.col("m.clipping_ratio"), gate).alias("quality_score"),
        F.col("m.snr_db").alias("estimated_snr_db"), F.col("m.silence_ratio").alias("silence_ratio"), F.lit(c.hash(*ANALYSIS)).alias("pipeline_hash"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"),
    )
    return sinks.fixed_columns(out, CLIPS)


def _heard(c: Config, content, told):
    """What a transcriber hears; asr: backend (a registered one, or mock with mock_mode)."""
    return backends.mock_transcript(told, c.asr.get("mock_mode", "echo")) if c.asr["backend"] == "mock" else backends.transcripts(content, c.asr["backend"])


def _asr_reason(c: Config, content, told):
    """The transcription gate's reason, under the limits in asr."""
    if not c.asr:
        return F.lit(None).cast("string")
    limits = {k: v for k, v in c.asr.items() if k not in ("backend", "mock_mode", "sync_text", "hypothesis_phonemes")}
    heard, none = F.col("heard"), F.lit(None).cast("double")
    return quality.asr_reason(heard, told, none, tokens.char_error_rate(heard, told), None, content.isNotNull(), quality.AsrGate(**limits))


def _written_back(c: Config, rows: DataFrame):
    """Clips that pass every gate take what was heard: as their text (sync_text), as what their phonemes are read from
    (hypothesis_phonemes), or as both; others keep their own. read_as is what phonemes are read from."""
    passed = F.col("reason").isNull() & F.col("heard").isNotNull()
    heard = F.when(passed, text.normalize_for_tts(F.col("heard")))
    rows = rows.withColumn("read_as", F.coalesce(heard, F.col("text_norm")) if c.asr.get("hypothesis_phonemes") else F.col("text_norm"))
    return rows.withColumn("text_norm", F.coalesce(heard, F.col("text_norm")) if c.asr.get("sync_text") else F.col("text_norm")), F.col("reason")


def _aligned(c: Config, rows: DataFrame) -> DataFrame:
    """Clips that passed all gates are aligned with their phones; aligner: backend, a registered model of emissions, the
    least mean log probability (min_score) of a token that counts as found, and the error rate that is let pass (max_rate)."""
    passed = F.when(F.col("reason").isNull(), F.col("processed.content"))
    rows = align.aligned(rows.withColumn("passed", passed), "passed", "phones", c.aligner["backend"])
    found = F.transform(F.filter("aligned", lambda s: s.score >= c.aligner.get("min_score", float("-inf"))), lambda s: s.token)
    why = quality.aligner_reason(found, F.col("phones"), "nfa", c.aligner.get("max_rate", 0.0))
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.size("phones") > 0, why))).drop("passed")


def secondary(rows: DataFrame, chain: list[dict], gate: quality.Gate) -> DataFrame:
    """A second pass over finished clips (clip_id, content, text_norm, quality_score): processed again and gated again.
    The first pass's score stays as primary_quality_score; reasons begin with `secondary_`."""
    done = rows.withColumn("p", steps.process_udf(chain)(F.col("content"))).withColumn("m", F.col("p.m"))
    reason = F.coalesce(F.col("p.reason"), quality.gate_reason(F.col("m"), F.length("text_norm"), None, gate))
    score = quality.quality_score(F.col("m.snr_db"), F.col("m.silence_ratio"), F.col("m.clipping_ratio"), gate)
    return done.select(
        "clip_id", F.col("p.content").alias("content"), "text_norm", F.col("quality_score").alias("primary_quality_score"), score.alias("quality_score"), F.concat(F.lit("secondary_"), reason).alias("reject_reason")
    )


def coverage_index(spark: SparkSession, c: Config, prior: DataFrame | None = None) -> DataFrame:
    """The coverage index: features of every clip by its text, and cheap signs of its recording. Rows of an index before
    with the same place, sentence and recording are taken up."""
    rows = scan(spark, c)
    joined = tables.with_recordings(rows, tables.recordings(spark, c.audio))
    kept = None
    if prior is not None:
        places = joined.select(F.col("path").alias("source_path"), F.col("row_index").alias("source_row_index"), "sentence", "audio_sha256")
        known = cut(joins.reusable_index(places, prior).where("reuse").select("source_path", "source_row_index", F.col("prior_clip_id").alias("clip_id")), "indexed")
        kept = prior.join(known.select("clip_id"), "clip_id", "left_semi")
        joined = joined.join(known, (F.col("path") == F.col("source_path")) & (F.col("row_index") == F.col("source_row_index")), "left_anti")
    joined = joined.withColumn("text_norm", text.normalize_for_tts(F.col("sentence"))).withColumn("cheap_quality", metrics.cheap_udf("recording")).withColumn("m", metrics.metrics_udf("recording"))
    phones = tokens.split_tokens(F.lower("text_norm"))
    keys = F.flatten(F.array(tokens.keys_of("phoneme", phones), tokens.keys_of("mora", text.morae(F.col("text_norm"))), tokens.keys_of("biphone", tokens.biphones_with_ends(phones))))
    votes = lambda n: (F.expr(f"try_cast(trim({n}) as long)") if n in rows.columns else F.lit(None).cast("long")).alias(n)
    out = joined.select(
        clip_id(F.lit(c.release), F.col("path"), F.col("row_index"), F.col("audio_sha256"), F.col("sentence")).alias("clip_id"), F.col("path").alias("source_path"), F.col("row_index").alias("source_row_index"),
        "client_id", "sentence", F.col("text_norm").alias("normalized_text"), F.col("m.duration_sec").alias("duration_sec"), votes("up_votes"), votes("down_votes"), "audio_sha256", keys.alias("feature_keys"),
        "cheap_quality", F.col("recording").isNull().alias("invalidated"),
    )
    out = sinks.fixed_columns(out, INDEX)
    return out if kept is None else sinks.fixed_columns(kept, INDEX).unionByName(out)


def analyze_some(spark: SparkSession, c: Config, index: DataFrame, ids: DataFrame) -> DataFrame:
    """The clips of an index that `ids` names, analysed; for a coverage loop's batches."""
    places = index.join(ids, "clip_id", "left_semi").select(F.col("source_path").alias("path"), F.col("source_row_index").alias("row_index"))
    return _analyzed(spark, c, scan(spark, c).join(F.broadcast(places), ["path", "row_index"], "left_semi"))  # a batch


def plan_split(clips: DataFrame, c: Config) -> DataFrame:
    """clip_id, split of every clip that may be split."""
    usable = clips.where(filters.splittable(F.col("disposition")))
    families = features.family_tokens(c.split_families, features.SPLIT_FAMILIES)
    rows = agg.incidence(usable, families)
    critical = agg.critical_features(agg.feature_counts(rows))
    if c.protocol == "unseen_speaker":
        assigned = split.unseen_speaker(usable, agg.protected_speakers(rows, critical), c.ratios, c.seed)
        return joins.with_split(usable, assigned).select("clip_id", "split")
    marked = usable.withColumn("features", F.flatten(F.array(*[tokens.keys_of(f, x) for f, x in families.items()])))
    if c.protocol == "single_speaker":
        return split.single_speaker(marked, c.ratios, c.seed).select("clip_id", "split")
    columns = {"audio": "audio_sha256", "sentence": "sentence_id", "text": "text_norm"}
    policies = {columns[d]: p for d, p in c.leakage.items() if d in columns}
    return split.seen_speaker(marked, critical, c.ratios, policies, c.seed).select("clip_id", "split")


def select(clips: DataFrame, splits: DataFrame, c: Config, overrides: DataFrame | None = None) -> DataFrame:
    """The selection plan: within each split where speakers were split first, else over all clips."""
    pool = clips.where(filters.selectable(F.col("disposition"))).drop("split").join(splits, "clip_id")
    pool = joins.apply_overrides(pool, overrides) if overrides is not None else pool.withColumn("override_action", F.lit(None).cast("string"))
    first = c.protocol == "unseen_speaker"
    families = features.family_tokens(c.families)
    keyed = F.flatten(F.array(*[tokens.keys_of(f, x) for f, x in families.items()]))
    groups = F.create_map(F.lit("exact_audio"), F.col("audio_sha256"), F.lit("same_normalized_text"), F.col("text_norm"))
    rows = pool.select(
        (F.col("split") if first else F.lit("all")).alias("bucket"), "clip_id", "speaker_id", "duration_sec", "quality_score", keyed.alias("tokens"),
        tokens.keys_of("phoneme", tokens.split_tokens(F.col("phonemes"))).alias("keys"), groups.alias("groups"), "override_action",
    )
    table = agg.target_table(agg.incidence(pool, families), c.alpha)
    total = c.hours * 3600
    until = {s: total * r for s, r in c.ratios.items()} if first else {"all": total}
    bounds = None
    if c.targets:
        wanted = clips.sparkSession.createDataFrame(target_rows(c.targets), "feature string, minimum long, desired long, required boolean, weight double")
        keys = rows.select("clip_id", "speaker_id", F.explode("keys").alias("feature"))
        bounds = selection.coverage_constraints(wanted, keys)
    weights = selection.Weights(exchanges=tuple(c.exchanges), families=c.family_weights, taus=c.family_taus)
    plan = selection.select(rows, table, until, selection.Limits(**c.limits), bounds, weights)
    return plan.drop("bucket").join(splits, "clip_id", "left")


#: Fields of the metadata, beside audio_path and utt_id.
METADATA = (
    "clip_id", "text_raw", "text_norm", "phonemes", "speaker_id", "sentence_id", "duration_sec", "quality_score", "estimated_snr_db", "silence_ratio", "split", "selection_rank", "source_release",
    "normalized_relative_source_path",
)


def materialize(clips: DataFrame, plan: DataFrame, c: Config) -> None:
    """metadata.jsonl of the selected clips, in all and by split, the trainers' lists and the processed recordings, in a
    folder that appears when it is complete."""
    rows = joins.plan_with_clips(plan.where("disposition = 'selected'"), clips).withColumn("audio_path", F.concat(F.lit("wavs/"), "clip_id", F.lit(".wav")))
    staging = f"{c.output}.staging"
    Path(staging).mkdir(parents=True, exist_ok=True)
    meta = rows.select("audio_path", F.col("clip_id").alias("utt_id"), *METADATA).orderBy("clip_id")
    line = F.to_json(F.struct("clip_id", "utt_id", "audio_path", *[x for x in METADATA if x != "clip_id"]), {"ignoreNullFields": "false"}).alias("value")
    sinks.one_file(meta.select(line), f"{staging}/metadata.jsonl")
    for name in split.SPLITS:
        sinks.one_file(meta.where(F.col("split") == name).select(line), f"{staging}/metadata.{name}.jsonl")
    sinks.one_file(sinks.ljspeech(rows), f"{staging}/ljspeech.tsv")
    sinks.one_file(sinks.ljspeech_metadata(rows), f"{staging}/metadata.csv")
    sinks.one_file(sinks.piper(rows), f"{staging}/piper.txt")
    sinks.one_file(sinks.style_bert(rows), f"{staging}/esd.list")
    if c.audio:
        found = tables.with_recordings(rows.select("clip_id", F.col("normalized_relative_source_path").alias("path")), tables.recordings(clips.sparkSession, c.audio)).where("recording is not null")
        found = steps.processed(found.select("clip_id", "recording"), "recording", c.chain).select("clip_id", "processed.content")
        sinks.write_audio(found, f"{staging}/wavs")
    sinks.publish(staging, c.output)


def audit(clips: DataFrame, plan: DataFrame, c: Config, examples: int = 20) -> dict:
    """What the selection breaks: limits of speakers, leaks between splits. All leaks are written as a table, with the
    clips that leak; the report names their number and `examples` of them."""
    chosen = joins.plan_with_clips(plan.where("disposition = 'selected'"), clips)
    lim = selection.Limits(**c.limits)
    speakers = reports.speaker_audit(chosen, lim.max_clips_per_speaker, lim.max_duration_per_speaker) if lim.max_clips_per_speaker or lim.max_duration_per_speaker else None
    policies = c.leakage if c.protocol == "unseen_speaker" else c.leakage | {"speaker": "allow"}
    leaks = cut(reports.leakage(chosen, policies), "leaks")
    sinks.parquet(leaks, f"{c.work}/audit/leaks.parquet", leaks.schema)
    clips_of = reports.leaking_clips(chosen, leaks)
    sinks.parquet(clips_of, f"{c.work}/audit/leaking_clips.parquet", clips_of.schema)
    some = [r.asDict(recursive=True) for r in leaks.orderBy("dimension", "key").limit(examples).collect()]
    return {"speakers": [r.asDict() for r in speakers.collect()] if speakers is not None else [], "leaks": some, "leak_count": leaks.count()}


def coverage_audit(clips: DataFrame, plan: DataFrame, c: Config, index: DataFrame | None = None) -> DataFrame:
    """A row for each target: what was asked for, what there is, what was selected, and where that leaves it."""
    wanted = clips.sparkSession.createDataFrame(target_rows(c.targets), "feature string, minimum long, desired long, required boolean, weight double")
    keyed = clips.withColumn("feature_keys", tokens.keys_of("phoneme", tokens.split_tokens(F.col("phonemes"))))
    keys = keyed.where(filters.selectable(F.col("disposition"))).select("clip_id", "speaker_id", F.explode("feature_keys").alias("feature"))
    counts = agg.coverage_counts(index if index is not None else keyed)
    out = selection.coverage_constraints(wanted, keys, counts).join(agg.selected_coverage(keys, plan.where("disposition = 'selected'")), "feature", "left")
    out = out.na.fill(0, ["selected_count", "selected_speaker_count"])
    x = F.col
    status = reports.status_of_coverage(x("index_count"), x("eligible"), x("selected_count"), x("minimum"), x("desired"), F.lit(False))
    return out.withColumn("status", status)


#: Names of an audit's columns in its files.
AUDIT_NAMES = {
    "minimum": "configured_minimum", "desired": "configured_desired", "index_count": "index_candidate_count", "eligible": "eligible_candidate_count", "eligible_speakers": "eligible_speaker_count",
}


def coverage_reports(clips: DataFrame, plan: DataFrame, c: Config, folder: str) -> tuple[dict, int]:
    """The audit's files in a folder; features by status, and how many call for more clips. Under the policy `fail` these
    are an error."""
    audit = cut(coverage_audit(clips, plan, c), "coverage-audit")
    missing = cut(reports.missing_features(audit), "missing")
    family = tokens.family_of(F.col("feature"))
    reason = F.when(F.col("status").isin(*reports.MISSING), F.col("status"))
    told = audit.withColumns({"feature_family": family, "failure_reason": reason}).withColumnsRenamed(AUDIT_NAMES)
    summary, n = sinks.coverage_audit(folder, told, plan, missing), missing.count()
    if n and c.coverage_policy == "fail":
        raise ValueError(f"{n} features call for more clips: see {folder}/missing-features.json")
    return summary, n


def build(spark: SparkSession, c: Config, force: bool = False) -> dict:
    """All stages. An artefact made with the same settings is taken up; audit and output are always made anew."""
    work, manifest = Path(c.work), {"stages": {}, "warnings": c.lint()}
    work.mkdir(parents=True, exist_ok=True)
    marks = work / "stages.json"
    done = json.loads(marks.read_text()) if marks.exists() and not force else {}

    def stage(name: str, settings: str, make) -> None:
        began, skipped = time.perf_counter(), done.get(name) == settings
        if not skipped:
            make()
            done[name] = settings
            sinks.write_json(str(marks), done)
        manifest["stages"][name] = {"seconds": round(time.perf_counter() - began, 3), "skipped": skipped}

    def catalog() -> None:
        before = f"{work}/catalog/clips.parquet"
        prior = tables.catalog_clips(spark, before) if Path(before).exists() and not force else None
        clips = sinks.fixed_columns(analyze(spark, c, prior), CLIPS)
        sinks.parquet(clips, f"{work}/catalog/clips.parquet.new", CLIPS)
        kept = tables.catalog_clips(spark, f"{work}/catalog/clips.parquet.new")
        usable = kept.where(filters.counted(F.col("disposition")))
        counts = agg.feature_counts(agg.incidence(usable, agg.catalog_families()))
        sinks.catalog_bundle(f"{work}/catalog", {"clips": kept, "feature_counts": counts, "speaker_stats": agg.speaker_stats(kept), "duplicate_groups": agg.duplicate_groups(kept), "duplicate_members": agg.duplicate_members(kept)})

    read = lambda: tables.catalog_clips(spark, f"{work}/catalog/clips.parquet")
    splits_path, plan_path = f"{work}/plans/splits.parquet", f"{work}/plans/selection_plan.parquet"
    stage("analyze", c.hash("tsv", "audio", "speakers", "axes", "min_up_votes", "max_down_votes", *ANALYSIS), catalog)
    stage("plan_split", c.hash(), lambda: sinks.parquet(plan_split(read(), c), splits_path))
    stage("select", c.hash(), lambda: sinks.selection_plan(select(read(), spark.read.parquet(splits_path), c), plan_path))
    plan = spark.read.parquet(plan_path)
    if c.targets:
        manifest["coverage"], short = coverage_reports(read(), plan, c, f"{work}/audit")
        if short and c.coverage_policy == "warn":
            manifest["warnings"].append(f"{short} features call for more clips")
    began = time.perf_counter()
    materialize(read(), plan, c)
    manifest["audit"] = audit(read(), plan, c)
    manifest["stages"]["materialize_audit"] = {"seconds": round(time.perf_counter() - began, 3), "skipped": False}
    manifest["resources"] = {"seconds": round(sum(x["seconds"] for x in manifest["stages"].values()), 3), "cores": spark.sparkContext.defaultParallelism}
    manifest["counts"] = {r.disposition: r.n for r in plan.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
    sinks.write_json(f"{work}/run_manifest.json", manifest)
    return manifest
