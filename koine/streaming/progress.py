"""Progress of jobs as a stream: counts of events by job and window, the latest state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from koine.sinks.versioned import Catalog

EVENTS = "job_id string, ts timestamp, stage string, status string, done long, total long"


def progress_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON lines, one event a line, new files as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by job, status and window; what comes later than `late` no longer counts, so state stays bounded."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "job_id", "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "job_id", "status", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "done", "total", "stage", "status")).alias("e"))
    return last.select("job_id", "e.*")


def upsert_catalog(clips: DataFrame, path: str, checkpoint: str, schema) -> StreamingQuery:
    """Merge analysed clips into a catalog in versions, a micro-batch at a time; the newest row of a clip wins. A batch
    rewrites the buckets that it touches; one that is repeated after a failure merges to the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        Catalog(batch.sparkSession, path, schema).merge(batch)

    return clips.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
