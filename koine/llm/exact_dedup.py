"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its bytes, taken modulo two primes. Chunks are hashed side by side and
combined by length-shifted arithmetic, so a huge text costs no more memory than its chunks. Texts with equal
fingerprint and length then undergo a chunkwise comparison: of each chunk place of such a group the smallest and
the largest content are aggregated, map-side first, and differ only if the group holds different texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship, text_slices, texts_of, with_totals

#: The two moduli, largest primes below 2**31, and the bases.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Bytes of a hashed chunk: products stay below 2**8 * 2**31 * 2**11 and are exact as doubles.
CHUNK = 1 << 11
#: Bytes of a compared chunk.
COMPARED = 1 << 16
BLANKS = b" \t\n\x0b\x0c\r"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += step
    return out[:n]


_WEIGHTS = np.stack([_powers(b, p, CHUNK)[::-1] for b, p in zip(BASES, PRIMES, strict=True)], axis=1).astype(np.float64)


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
    """The fingerprint of two texts put together."""
    return tuple((a * pow(b, right_bytes, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Residues (text, prime). Zero bytes before a text don't change its polynomial, so chunks are cut from the end."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    chunks = -(-sizes // CHUNK)
    data = np.zeros((int(chunks.sum()), CHUNK), dtype=np.uint8)
    ends = np.cumsum(chunks)
    flat = data.ravel()
    for text, end in zip(texts, ends.tolist(), strict=True):
        flat[end * CHUNK - len(text) : end * CHUNK] = np.frombuffer(text, dtype=np.uint8)
    out = np.zeros((len(texts), 2), dtype=np.uint64)
    full = np.flatnonzero(chunks)
    if not len(full):
        return out
    hashed = np.concatenate([data[i : i + 1024].astype(np.float64) @ _WEIGHTS for i in range(0, len(data), 1024)])
    shift = np.repeat(ends, chunks) - 1 - np.arange(len(data))
    for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
        powers = _powers(pow(base, CHUNK, prime), prime, int(chunks.max()))
        terms = hashed[:, k].astype(np.uint64) % np.uint64(prime) * powers[shift] % np.uint64(prime)
        out[full, k] = np.add.reduceat(terms, (ends - chunks)[full]) % np.uint64(prime)
    return out


def _row_key() -> Column:
    """Tells apart rows with one doc_id; a row is known by its doc_id and this."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull())


def _narrow(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, n_chars, n_bytes, fingerprint, text_sha256 of the normalised texts."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = texts_of(part)
                plain = [t.encode().translate(None, BLANKS) for t in texts]
                residues = fingerprints(plain)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_key"),
                        pa.array([len(t) for t in texts], type=pa.int64()),
                        pa.array([len(t) for t in plain], type=pa.int64()),
                        pa.array((residues[:, 0] << np.uint64(31) | residues[:, 1]).astype(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in plain], type=pa.string()),
                    ],
                    ["doc_id", "row_key", "n_chars", "n_bytes", "fingerprint", "text_sha256"],
                )

    ship(documents.sparkSession)
    docs = documents.select("doc_id", "text", _row_key().alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row_key long, n_chars long, n_bytes long, fingerprint long, text_sha256 string")


def _collided(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(fingerprint, n_bytes) that stand for more than one text, found by comparing the texts chunk by chunk."""
    key = ["fingerprint", "n_bytes"]
    members = rows.filter("group_size > 1 and n_bytes > 0").select("row_key", *key).distinct()
    texts = documents.select(_row_key().alias("row_key"), "text").join(members, "row_key")
    plain = F.encode(F.translate("text", BLANKS.decode(), ""), "utf-8")
    places = F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {COMPARED})"))
    chunks = texts.select(*key, plain.alias("plain")).select(*key, "plain", places.alias("place"))
    chunks = chunks.select(*key, "place", F.expr(f"substring(plain, cast(place * {COMPARED} + 1 as int), {COMPARED})").alias("chunk"))
    seen = chunks.groupBy(*key, "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return seen.filter("low != high").select(*key).distinct()


def duplicate_classes(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, keep_id, group_size, kept, text_sha256 for each row of documents(doc_id, text).

    Texts are equal when identical without their ASCII white space; null counts as empty. The row with the most
    code points in the original text stays, then the smallest doc_id (null last). Repeated rows of the doc_id that
    stays are all marked kept; drop_duplicates() leaves one. Other columns are ignored. Empty table: no rows.
    """
    narrow = cut(_narrow(documents), "fingerprints")
    key = ["fingerprint", "n_bytes"]
    rows = cut(_with_groups(narrow, key), "groups")
    collided = cut(_collided(documents, rows), "collided")
    if not collided.isEmpty():  # different texts under one fingerprint: told apart by their digests
        marked = narrow.join(collided.withColumn("apart", F.lit(True)), key, "left")
        rows = _with_groups(marked.withColumn("apart", F.when(F.col("apart"), F.col("text_sha256")).otherwise("")), [*key, "apart"])
    return rows.select("doc_id", "row_key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chars")


def _with_groups(narrow: DataFrame, key: list[str]) -> DataFrame:
    """Rows with keep_id and group_size of their group."""
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id")
    partial = {"first": F.min(best), "n": F.count("*")}
    out = with_totals(narrow, key, "row_key", partial, {"first": F.min("first"), "group_size": F.sum("n")})
    return out.withColumn("keep_id", F.col("first.doc_id")).drop("first")


def dedup_report(documents: DataFrame) -> DataFrame:
    """One row per row of documents, dropped ones too."""
    return duplicate_classes(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns: one of each class of equal texts."""
    rows = duplicate_classes(documents).filter("kept")
    per = rows.groupBy("keep_id", "text_sha256").agg(F.min(F.struct(-F.col("n_chars"), "row_key")).alias("m"))
    stay = cut(per.select(F.col("keep_id").alias("__id"), F.col("m.row_key").alias("__stay")).distinct(), "stay")
    same = (F.col("__row") == F.col("__stay")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = documents.withColumn("__row", _row_key()).join(stay, same, "left_semi")
    again = documents.groupBy("doc_id", _row_key().alias("__stay")).count().filter("count > 1").select(F.col("doc_id").alias("__id"), "__stay")
    again = cut(again, "again")
    if again.isEmpty():
        return kept.select(*documents.columns)
    once, more = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "__row"])).select(*documents.columns)


ORACLE = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS kept,
  sha256(norm) AS text_sha256
FROM plain
"""
