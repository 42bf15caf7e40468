import random
import re
import zlib
from collections import Counter

import pytest

from koine.llm import mixing, sharding


def texts(n, seed, hot=0.0):
    rng = random.Random(seed)
    return [(i, "hot text" if rng.random() < hot else rng.choice(["", f"text {i % (n // 2)}", f"only {i}", None])) for i in range(n)]


@pytest.mark.parametrize("n, hot", [(1, 0), (10, 0), (500, 0), (500, 0.4)])
def test_shards(spark, n, hot):
    rows = texts(max(n, 2), n, hot)[:n] + [(3, "again"), (3, "again"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as hub")
    out = sharding.shard_documents(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in out))) == sorted(map(repr, ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)))
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min([counts.get(b, 0) for b in range(24)]) <= 1 and set(counts) <= set(range(24))
    for b in counts:
        assert sorted(r.slot for r in out if r.shard == b) == list(range(counts[b]))
    where = {}
    for r in out:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    quota, sizes = len(out) // 24, Counter(r.text_crc32 for r in out)
    assert all(len(s) <= -(-sizes[k] // max(1, quota)) + 4 for k, s in where.items() if sizes[k] > quota), "a large group fills few shards"
    small = [len(s) - 1 for k, s in where.items() if 1 < sizes[k] <= quota]
    assert sum(small) <= 0.4 * len(small) + 1, "groups that fit stay whole"


def test_links_of_any_kind(spark):
    """A grid of hubs: neighbours end up together more often than by chance."""
    docs = spark.range(400).withColumnRenamed("id", "node")
    links = docs.selectExpr("node", "node div 10 as hub").unionByName(docs.selectExpr("node", "1000 + node div 20 as hub"))
    out = {r.node: r.shard for r in sharding.balanced_label_propagation(docs, links, 8).collect()}
    assert set(Counter(out.values()).values()) == {50}
    together = sum(out[a] == out[b] for a in range(400) for b in range(a) if a // 20 == b // 20)
    assert together > 0.6 * 400 * 19 / 2


def test_no_documents(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: weights[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left = share * sum(sizes.values()) - sum(ceiling * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and left * weight[s] / total > ceiling * sizes[s]} if total else set()
        if not new:
            return {s: ceiling * sizes[s] if s in capped else left * weight[s] / total for s in order}
        capped |= new


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(3000)]
    rows += [(9999, None, "a"), (9998, "x", "a"), (9998, "x", "a"), (None, "y z", "b"), (9997, " \n", "empty source")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "7 as copies")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    out = mixing.mixed_copies(docs).collect()
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.copies <= 2 and r.size == size(r.text)
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 60 for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    report = sorted(map(repr, ((r.doc_id, r.size, r.taken) for r in mixing.mixing_report(docs).collect())))
    assert report == sorted(map(repr, ((r.doc_id, r.size, r.copies * r.size) for r in out)))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out) and mixed.where("size <> 1 or copies <> 7").isEmpty()
    assert mixing.mixing_report(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = "word " * 400000
    docs = spark.createDataFrame([(1, long, "a"), (2, long, "a"), (3, "x", "b"), (4, None, None)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    assert out[1]["size"] == len(long) + 8 and out[1].text_crc32 == zlib.crc32(long.encode()) and len({r.shard for r in out.values()}) == 4
    mixed = {r.doc_id: (r["size"], r.taken) for r in mixing.mixing_report(docs).collect()}
    assert mixed[1][0] == 400000 and mixed[1][1] in (0, 400000, 800000) and mixed[4] == (0, 0)
