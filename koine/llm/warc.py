"""WARC revisits: not-modified captures take their content from the latest earlier full response of their URL.

An as-of join by canonical URL: within a range of capture times by a window, across ranges by the last response of
each range before it. No URL is gathered whole: a window sees one URL in one range, and one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't select content.
TRACKING = "utm_[a-z]*|ref|fbclid|gclid"
#: Ranges of capture times.
RANGES = 256


def canonical_url(url: Column) -> Column:
    """Scheme, www., port 80 or 443, fragment, tracking parameters and a slash at the end dropped; host in lower
    case; parameters sorted. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[^/?]*", 0)), "^www\\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(plain, "\\?(.*)$", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"^({TRACKING})=") & (p != "")))
    joined = F.array_join(wanted, "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """What each revisit of records(record_id, url, captured, revisit, etag, modified, headers) resolves to.

    captured: long; revisit: boolean, null counts as a full response; etag, modified: validators, null for none;
    headers: map of lower-case names. Returns record_id, canonical_url, captured, original_id, status, headers of every
    revisit. The original is the response of the same canonical URL with the latest time before the revisit's, of equal
    times the one with the largest record_id. status: `missing` without one, `changed` where both sides have an etag
    and they differ, or, one side lacking it, both have modified and they differ; else `resolved`. Headers are the
    original's, with those permitted for a 304 taken from the revisit; null unless resolved. A null URL or time
    resolves to nothing. Other columns are ignored. Repeated rows are resolved each; of responses with one record_id the
    headers are those that come first as JSON. Empty table: no rows.
    """
    full = ~F.coalesce("revisit", F.lit(False))
    base = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured").cast("long").alias("captured"), full.alias("full"), "etag", "modified", "headers"
    )
    low, high = base.agg(F.min("captured"), F.max("captured")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
    base = base.withColumn("range", F.floor((F.col("captured") - (low or 0)) / width))
    found = F.when(F.col("full"), F.struct("captured", "record_id", "etag", "modified"))
    known = base.withColumn("own", found)
    within = Window.partitionBy("canonical_url", "range").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("near", F.max("own").over(within))
    last = known.filter("full and canonical_url is not null and captured is not null").groupBy("canonical_url", "range").agg(F.max("own").alias("last"))
    revisits = known.filter("not full")
    asked = revisits.filter("near is null").select("canonical_url", "range").distinct()
    across = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = last.join(asked, ["canonical_url", "range"], "full").withColumn("far", F.max("last").over(across)).select("canonical_url", "range", "far")
    usable = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    out = revisits.join(before, ["canonical_url", "range"], "left").withColumn("original", F.when(usable, F.coalesce("near", "far")))
    first = F.min_by("headers", F.coalesce(F.to_json("headers"), F.lit("")))  # of repeated ids always the same one
    texts = base.filter("full").groupBy(F.col("record_id").alias("__id")).agg(first.alias("__headers"))
    out = out.withColumn("__key", F.coalesce("original.record_id", F.xxhash64("record_id")))  # rows without one don't meet in one task
    out = out.join(texts, (F.col("__key") == F.col("__id")) & F.col("original").isNotNull(), "left")
    by_etag = F.col("etag").isNotNull() & F.col("original.etag").isNotNull()
    differs = F.when(by_etag, F.col("etag") != F.col("original.etag")).otherwise(F.coalesce(F.col("modified") != F.col("original.modified"), F.lit(False)))
    status = F.when(F.col("original").isNull(), "missing").when(differs, "changed").otherwise("resolved")
    none = F.create_map().cast("map<string,string>")
    taken = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("__headers", none), lambda k, _: ~F.array_contains(F.map_keys(taken), k))
    return out.select(
        "record_id", "canonical_url", "captured", F.col("original.record_id").alias("original_id"), status.alias("status"), F.when(status == "resolved", F.map_concat(kept, taken)).alias("headers")
    )


def resolved_payloads(records: DataFrame, payload: str = "payload") -> DataFrame:
    """record_id, payload of resolved revisits: the original's."""
    texts = records.filter("not coalesce(revisit, false)").select(F.col("record_id").alias("original_id"), payload)
    return resolve_revisits(records).filter("status = 'resolved'").join(texts, "original_id").select("record_id", payload)


#: Captures between a page and its revisit in captures_of().
LATER = 1000


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log over pages(page_id, url, html): each page is a full response at 2 * page_id, and LATER captures on
    a revisit that carries its validator; every tenth page has a revisit right before it, too."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    n = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    log = pages.select("page_id", "url", tag.alias("etag"), n.alias("n")).withColumn("part", F.explode(F.when(F.col("page_id") % 10 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(*map(F.lit, (0, 1))))))
    first = F.col("part") == 0
    captured = F.when(first, 2 * F.col("page_id")).when(F.col("part") == 1, 2 * F.col("page_id") + 2 * LATER + 1).otherwise(2 * F.col("page_id") - 1)
    headers = F.when(first, F.create_map(F.lit("content-length"), F.col("n"), F.lit("date"), captured.cast("string"))).otherwise(
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), captured.cast("string"))
    )
    return log.select(
        (F.col("page_id") * 4 + F.col("part")).cast("long").alias("record_id"), "url", captured.cast("long").alias("captured"), (~first).alias("revisit"), "etag", F.lit(None).cast("string").alias("modified"), headers.alias("headers")
    )


def revisit_report(pages: DataFrame) -> DataFrame:
    """Every revisit of captures_of(pages), with the merged headers in two columns."""
    out = resolve_revisits(captures_of(pages))
    return out.select(
        "record_id", "canonical_url", "captured", "original_id", "status", F.col("headers")["content-length"].alias("content_length"), F.col("headers")["date"].alias("date")
    )


ORACLE = f"""
WITH plain AS (
  SELECT page_id, md5(coalesce(html, '')) AS etag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS n,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS p FROM pages
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(p, '^[^/?]*', 0)), '^www\\.|:80$|:443$', '', 'g') AS host,
    regexp_replace(regexp_extract(p, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(p, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})='))), '&') AS query FROM plain
), urls AS (
  SELECT page_id, etag, n, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM parts
), responses AS (
  SELECT page_id * 4 AS record_id, canonical_url, 2 * page_id AS captured, etag, n FROM urls
), revisits AS (
  SELECT page_id * 4 + 1 AS record_id, canonical_url, 2 * page_id + {2 * LATER + 1} AS captured, etag FROM urls
  UNION ALL SELECT page_id * 4 + 2, canonical_url, 2 * page_id - 1, etag FROM urls WHERE page_id % 10 = 0
), joined AS (
  SELECT v.record_id, v.canonical_url, v.captured, v.etag, r.record_id AS original_id, r.etag AS original_etag, r.n
  FROM revisits v ASOF LEFT JOIN responses r ON v.canonical_url = r.canonical_url AND v.captured > r.captured
)
SELECT record_id, canonical_url, captured, original_id,
  CASE WHEN original_id IS NULL THEN 'missing' WHEN etag <> original_etag THEN 'changed' ELSE 'resolved' END AS status,
  CASE WHEN etag = original_etag THEN n END AS content_length,
  CASE WHEN etag = original_etag THEN CAST(captured AS VARCHAR) END AS date
FROM joined
"""
