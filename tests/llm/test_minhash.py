import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from koine.llm import components as cc
from koine.llm import minhash as mh


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@given(st.lists(st.text(alphabet="aAbÉ \n\x85", max_size=30), max_size=6), st.sampled_from([1, 2, 5]))
def test_sets_are_those_of_the_words(texts, width):
    got = mh.shingle_sets(texts, width)
    plain = [plain_set(t, width) for t in texts]
    assert [len(s) for s in got] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


def test_signatures_match_the_definition():
    """Element by element, with the whole permutation and without stopping early."""
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 3, 40, 700)]
    got = mh.signatures(sets, 16)
    for s, row in zip(sets, got, strict=True):
        want = np.full(16, np.inf)
        for e in s:
            perm = list(range(16))
            for j in range(16):
                x = mh._mix(np.array([e + np.uint64(j + 1) * mh._GOLDEN], dtype=np.uint64))
                place = j + int(mh._mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0] % np.uint64(16 - j))
                perm[j], perm[place] = perm[place], perm[j]
                want[perm[j]] = min(want[perm[j]], j + float(x[0] >> np.uint64(11)) * 2.0**-53)
        assert np.array_equal(row, want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.8):
        hits = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 400).astype(np.uint64)
            both = int(400 * j)
            own = (400 - both) // 2
            a, b = pool[: both + own], np.concatenate([pool[:both], pool[both + own :]])
            x, y = mh.signatures([a, b])
            hits.append((x == y).mean())
        assert abs(np.mean(hits) - j) < 0.02


def brute(rows, width, percent=80):
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, size=8):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(900)]
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150]))
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 16))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, "one", "ONE", " one ", "a b", "A  b", "x" * 50000]
    rng.shuffle(rows)
    return [(10 + 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as bands").repartition(3)
    assert sorted(tuple(r) for r in mh.near_duplicates(docs, width).collect()) == brute(rows, width)
    assert sorted(r.doc_id for r in mh.drop_near_duplicates(docs, width).collect()) == [r[0] for r in brute(rows, width) if r[3]]


def test_one_large_group(spark):
    """Copies that often link to the original only, in buckets of hundreds."""
    rng, vocabulary = random.Random(9), [f"w{i}" for i in range(5000)]
    base, rows = rng.choices(vocabulary, k=120), []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(2, 9)):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows.append((300, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in mh.near_duplicates(docs, 2).collect()) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (6, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in mh.near_duplicates(docs, 2).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (None, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 6, True)], key=repr)
    assert mh.near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_document_share_their_links(spark):
    a, b, c = "a b c d e f g h i j k l", "m n o p q r s t", "u v w x y z"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (7, c), (7, "one two")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in mh.near_duplicates(docs, 2).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]


def test_left_over_components_in_one_bucket(spark):
    """Every class in one bucket, all pivots' links withheld: what is left over still finds every link, and the count of
    shared shingles turns down only sets without one."""
    rows = [r for r in corpus(11, groups=6, size=10) if plain_set(r[1], 2)]
    texts = {}
    for i, t in rows:
        texts.setdefault(frozenset(plain_set(t, 2)), (i, t))
    rows = sorted(texts.values())
    F = __import__("pyspark.sql.functions").sql.functions
    docs = spark.createDataFrame(rows, "node long, text string")
    sets = docs.mapInArrow(mh._full_sets(2), "node long, shingles array<long>").cache()
    buckets = docs.select("node", F.lit(0).alias("band"), F.lit(1).alias("key"), F.lit(len(rows)).cast("long").alias("n"))
    none = docs.select("node", F.col("node").alias("component")).limit(0)
    want, of = set(), {i: plain_set(t, 2) for i, t in rows}
    for i in of:
        want |= {(i, j) for j in of if i < j and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j])}
    top = max(of)  # of components of one the largest number wins
    got = {tuple(r) for r in mh._left_over(buckets, none, sets, 80).collect()}
    assert want and got == want
    asking = mh._asking(buckets, none.select("node", F.col("component").alias("c")))
    assert {r.node for r in asking.collect()} == set(of) - {top} and {r.top for r in asking.collect()} == {top}
    linked = {i for pair in want for i in pair} - {top}
    hopeful = {r.node for r in mh._hopeful(asking, asking.unionByName(asking.select("top", F.col("top").alias("node"), F.col("top").alias("c")).distinct()), sets, 80).collect()}
    assert linked <= hopeful < set(of)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    rng.shuffle(pairs)
    want = {x: r for x, r in cc.union_find(pairs).items() if x != r}
    got = cc.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
