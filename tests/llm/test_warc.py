import random

from koine.llm import warc


def test_canonical_urls(spark):
    given = {
        "HTTP://www.A.com:80/x/?b=2&utm_source=f&a=1#top": "a.com/x?a=1&b=2",
        "https://a.com/x": "a.com/x",
        "https://a.com": "a.com",
        "a.com/?ref=q": "a.com",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in given], "url string")
    assert {r.url: r.c for r in df.select("url", warc.canonical_url(df.url).alias("c")).collect()} == given


def brute(rows):
    out = []
    full = [r for r in rows if not r[3]]
    for i, url, at, revisit, etag, modified, headers in rows:
        if not revisit:
            continue
        earlier = [r for r in full if url is not None and at is not None and r[1] == url and r[2] is not None and r[2] < at]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        status, merged = "missing", None
        if best:
            if etag is not None and best[4] is not None:
                same = etag == best[4]
            else:
                same = modified is None or best[5] is None or modified == best[5]
            status = "resolved" if same else "changed"
        if status == "resolved":
            merged = dict(best[6] or {}) | {k: v for k, v in (headers or {}).items() if k in warc.PERMITTED}
        out.append((i, url, at, best and best[0], status, merged))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        url = rng.choice(["hot.com", "hot.com", f"u{rng.randrange(40)}.com", None])
        headers = rng.choice([None, {}, {"date": str(i), "server": "s"}, {"vary": "x"}])
        rows.append((i, url, rng.choice([None, *range(300)]), rng.choice([True, True, False, None]), rng.choice([None, "e1", "e2"]), rng.choice([None, "m1", "m2"]), headers))
    schema = "record_id long, url string, captured long, revisit boolean, etag string, modified string, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as range", "2 as original").repartition(3)
    got = sorted((tuple(r) for r in warc.resolve_revisits(df).collect()), key=repr)
    assert sorted(map(repr, [(*r[:5], r[5] and sorted(r[5].items())) for r in got])) == sorted(map(repr, [(*r[:5], r[5] and sorted(r[5].items())) for r in brute(rows)]))
    assert warc.resolve_revisits(df.limit(0)).count() == 0


SCHEMA = "record_id long, url string, captured long, revisit boolean, etag string, modified string, headers map<string,string>, payload string"


def test_repeated_ids_ties_and_long_values(spark):
    long = "x" * 200000
    rows = [
        (1, "a.com/" + long, 1, False, None, "m", {"server": "b"}, "one"), (1, "a.com/" + long, 1, False, None, "m", {"server": "a"}, "two"),
        (2, "a.com/" + long, 5, False, None, "m2", {"server": long}, "three"), (3, "a.com/" + long, 5, False, None, "m2", {"server": "c"}, "four"),
        (10, "http://www.a.com/" + long, 3, True, None, "m", {"date": "d", "server": "no"}, None), (11, "a.com/" + long, 9, True, None, "m2", None, None), (12, "a.com/" + long, 9, True, None, "other", None, None),
    ]
    for n in (1, 4):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        got = {r.record_id: (r.original_id, r.status, r.headers) for r in warc.resolve_revisits(df).collect()}
        assert got == {10: (1, "resolved", {"server": "a", "date": "d"}), 11: (3, "resolved", {"server": "c"}), 12: (3, "changed", None)}
    assert sorted(tuple(r) for r in warc.resolved_payloads(df).collect()) == [(10, "one"), (10, "two"), (11, "four")]


def test_captures_of_pages(spark):
    pages = spark.createDataFrame([(10, "a.com", "body"), (11, "b.com", None), (11, "b.com", None)], "page_id long, url string, html string").selectExpr("*", "1 as etag")
    log = {(r.record_id, r.captured, r.revisit, r.headers["content-length"]) for r in warc.captures_of(pages).collect()}
    assert log == {(40, 20, False, "4"), (41, 2021, True, "0"), (42, 19, True, "0"), (44, 22, False, "0"), (45, 2023, True, "0")}
    out = {(r.record_id, r.original_id, r.status, r.content_length) for r in warc.revisit_report(pages).collect()}
    assert out == {(41, 40, "resolved", "4"), (42, None, "missing", None), (45, 44, "resolved", "0")}
