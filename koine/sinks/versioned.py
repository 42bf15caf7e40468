"""A catalog in versions: rows in buckets by their key's hash, and snapshots that name each bucket's folder.

A merge writes the buckets that its rows touch into a new folder, then one snapshot file that names these and, for all other
buckets, the folders of the snapshot before. That file is the commit: readers see the catalog before it or after it, whatever
is killed in between. All of it goes through Hadoop's file system; nothing is renamed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koine.operators.joins import upsert

#: Last line of a complete snapshot; one without it was cut off and doesn't count.
COMPLETE = "complete"


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    buckets: int
    folders: dict[int, str]


class Catalog:
    """A catalog below a folder, with rows of a schema, one a key."""

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "clip_id", order: str = "analyzed_at", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        fs, at = self._fs(path)
        if fs.exists(at):
            raise Conflict(path)
        stream = fs.create(at, False)  # fails where another writer was first
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def snapshots(self) -> list[Snapshot]:
        """Complete snapshots, oldest first."""
        out = []
        for name in self._names(f"{self.path}/snapshots"):
            lines = self._text(f"{self.path}/snapshots/{name}").split("\n")
            if len(lines) >= 2 and lines[1] == COMPLETE:
                told = json.loads(lines[0])
                out.append(Snapshot(told["version"], told["buckets"], {int(b): f for b, f in told["folders"].items()}))
        return out

    def latest(self) -> Snapshot | None:
        known = self.snapshots()
        if not known and self._names(self.path):
            taken = [n for n in self._names(self.path) if n not in ("data", "snapshots")]
            if taken:
                raise ValueError(f"{self.path} holds {taken[0]}, which is no catalog in versions")
        return known[-1] if known else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest where none is named; no rows before the first."""
        at = self.latest() if version is None else next(s for s in self.snapshots() if s.version == version)
        return self._rows(at, None)

    def _rows(self, at: Snapshot | None, buckets: list[int] | None) -> DataFrame:
        folders = sorted(f for b, f in (at.folders if at else {}).items() if buckets is None or b in buckets)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, rows: DataFrame) -> Snapshot | None:
        """Rows put in place of those with their keys, of equal keys the latest by `order`; the new snapshot. Without rows
        the one before stays. Merging the same rows once more gives the same table."""
        at = self.latest()
        n = at.buckets if at else self.buckets
        names = [f.name for f in self.schema]
        newest = rows.groupBy(self.key).agg(F.max(F.struct(self.order, F.struct(*names).alias("row"))).alias("m")).select("m.row.*")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")
        newest = newest.withColumn("__bucket", bucket)
        folder = f"data/{uuid.uuid4().hex}"
        fresh = f"{self.path}/{folder}-in"
        newest.write.parquet(fresh)  # once: a stream's rows aren't computed again
        arrived = self.spark.read.schema(newest.schema).parquet(fresh)
        touched = sorted(r[0] for r in arrived.select("__bucket").distinct().collect())  # a row a bucket
        if touched:
            merged = upsert(self._rows(at, touched).withColumn("__bucket", bucket), arrived, self.key)
            merged.repartition(len(touched), "__bucket").sortWithinPartitions("__bucket", self.key).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        fs, gone = self._fs(fresh)
        fs.delete(gone, True)
        if not touched:
            return at
        folders = dict(at.folders if at else {}) | {b: f"{folder}/__bucket={b}" for b in touched}
        new = Snapshot(at.version + 1 if at else 1, n, folders)
        self._create(f"{self.path}/snapshots/{self._next():08d}.json", json.dumps({"version": new.version, "buckets": n, "folders": folders}) + f"\n{COMPLETE}\n")
        return new

    def _next(self) -> int:
        names = self._names(f"{self.path}/snapshots")
        return int(names[-1].split(".")[0]) + 1 if names else 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` snapshots names, and older snapshots; how many folders went. Not while a
        merge runs: what that has written isn't named yet."""
        known = self.snapshots()
        for old in known[:-keep] if keep else []:
            for name in self._names(f"{self.path}/snapshots"):
                if json.loads(self._text(f"{self.path}/snapshots/{name}").split("\n")[0] or "{}").get("version") == old.version:
                    fs, at = self._fs(f"{self.path}/snapshots/{name}")
                    fs.delete(at, False)
        used = {f.split("/")[1] for s in known[-keep:] for f in s.folders.values()}
        gone = [n for n in self._names(f"{self.path}/data") if n not in used]
        for name in gone:
            fs, at = self._fs(f"{self.path}/data/{name}")
            fs.delete(at, True)
        return len(gone)
