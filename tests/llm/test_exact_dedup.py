import hashlib
import random
import re

from koine.llm import exact_dedup as xd


def test_fingerprints_compose():
    rng = random.Random(3)
    for n, m in [(0, 0), (0, 5), (5, 0), (10, 2048), (2049, 1), (9000, 70000)]:
        a, b = rng.randbytes(n), rng.randbytes(m)
        fa, fb, fab = xd.fingerprints([a, b, a + b]).tolist()
        assert list(xd.combine(tuple(fa), tuple(fb), m)) == fab
        plain = 0
        for x in a + b:
            plain = (plain * xd.BASES[0] + x) % xd.PRIMES[0]
        assert plain == fab[0]


ROWS = [(1, "a b"), (2, "ab "), (3, " a  b"), (4, None), (5, ""), (6, " \n"), (7, "zé "), (8, "zé \t"), (9, "x" * 200000), (10, "x " * 200000), (None, "q"), (12, "q"), (3, " a  b")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def test_report_and_filter(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as row_key")
    assert sorted((tuple(r) for r in xd.dedup_report(docs).collect()), key=repr) == brute(ROWS)
    kept = xd.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 8, 10, 12]
    assert xd.dedup_report(docs.limit(0)).count() == 0 and xd.drop_duplicates(docs.limit(0)).count() == 0


def test_collisions_are_found(spark, monkeypatch):
    """With every fingerprint equal, the comparison of chunks alone tells texts apart."""
    narrow = xd._narrow
    monkeypatch.setattr(xd, "_narrow", lambda d: narrow(d).selectExpr("doc_id", "row_key", "n_chars", "n_bytes", "0L as fingerprint", "text_sha256"))
    docs = spark.createDataFrame(ROWS + [(20, "ba"), (21, "b a")], "doc_id long, text string")
    assert sorted((tuple(r) for r in xd.dedup_report(docs).collect()), key=repr) == brute(ROWS + [(20, "ba"), (21, "b a")])
