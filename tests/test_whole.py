"""Queries over whole tables and whole texts, against plain versions on a small fixture."""

import random
from collections import Counter

import pytest

from koine.operators import selection, windows
from koine.plans import queries as core
from koine.plans.testdata import clips
from tests.plain_selection import run_kernel

N = 12


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") * rng.randrange(1, 4) for _ in range(rng.randrange(40, 200))) + f" last{i}" for i in range(N)]


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    vectors = [(i, [float((i * 7 + d * i * i) % 23) for d in range(4)], 0) for i in range(33)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, "u", "きゃ り" + "a" * i) for i in range(5)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_counts_read_whole_texts(spark, sf, texts):
    want = Counter(w for t in texts for w in t.split(" "))
    assert {r.feature: r["count"] for r in core.QUERIES["feature_counts"](spark, sf).collect()} == want
    pairs = Counter(f"{a}-{b}" for t in texts for a, b in zip(t.split(" "), t.split(" ")[1:]))
    got = core.feature_counts_ngrams(spark, sf).where("feature_type = 'biphone'").collect()
    assert {r.feature: r["count"] for r in got} == pairs


def test_clips_hold_whole_texts(spark, sf, texts):
    assert [r.phones for r in clips(spark, sf).orderBy("doc_id").collect()] == [t.split(" ") for t in texts]
    assert not any("list_slice(string_split" in sql or "LIMIT 1000" in sql for sql in core.ORACLE_SQL.values())


def test_edit_distances_of_whole_texts(spark, sf, texts):
    cer = {int(r.clip_id): r.cer for r in core.QUERIES["char_error_rate_whole"](spark, sf).collect()}
    per = {int(r.clip_id): r.per for r in core.QUERIES["token_error_rate"](spark, sf).collect()}
    for i, t in enumerate(texts):
        words = t.split(" ")
        assert cer[i] == round(distance(t, t[3:]) / len(t), 6) and per[i] == round(distance(words, words[2:]) / len(words), 6)


def test_nearest_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    want = {i: min(apart(v, w) for j, w in vectors.items() if j != i) for i, v in vectors.items()}
    for block in (5, 256):
        got = {r.vec_id: r.distance for r in windows.nearest_vectors(rows, "vec_id", "embedding", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    some = {r.vec_id: r.distance for r in windows.nearest_vectors(rows, "vec_id", "embedding", rows.where("vec_id % 7 = 0"), block=2).collect()}
    assert some.keys() == {i for i in want if i % 7 == 0} and all(abs(some[i] - want[i]) < 1e-9 for i in some)


def test_nearest_vectors_with_missing_numbers(spark):
    nan = float("nan")
    rows = [(1, [0.0, nan, 1.0]), (2, [0.0, 5.0, nan]), (3, [3.0, 5.0, 1.0]), (4, [None, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: round(r.distance, 6) for r in windows.nearest_vectors(df, "id", "v").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 3.0, 4: 4.0}
    assert windows.nearest_vectors(df.limit(1), "id", "v").count() == 0


def test_morae_of_all_pages(spark, sf):
    got = core.QUERIES["mora_split"](spark, sf).collect()
    assert Counter(r.page_id for r in got) == {i: 2 + i for i in range(5)}
    assert [r.mora for r in sorted(got, key=lambda r: (r.page_id, r.place)) if r.page_id == 1] == ["きゃ", "り", "a"]


def test_splits_see_all_critical_features(spark, sf, texts):
    held = {}
    for i, t in enumerate(texts):
        for w in t.split(" "):
            held.setdefault(w[:4], set()).add(f"src{i % 3}")
    critical = {w for w, s in held.items() if len(s) == 1}
    got = {int(r.clip_id): r.split for r in core.QUERIES["split_seen_speaker"](spark, sf).collect()}
    assert got.keys() == set(range(N)) and all(got[i] == "train" for i, t in enumerate(texts) if {w[:4] for w in t.split(" ")} & critical)
    speakers = {r.speaker_id: r.split for r in core.QUERIES["split_unseen_speaker"](spark, sf).collect()}
    assert speakers.keys() == {f"p{i}" for i in range(N)}


def test_exchanges_reach_the_whole_reserve():
    clip = lambda name, seconds, *tokens: {"clip_id": name, "speaker": "s", "duration": seconds, "quality": None, "tokens": sorted(tokens), "keys": set(), "groups": {}, "action": None}
    clips = [clip("p", 1.0, "a", "b"), clip("q", 1.0, "a", "c"), clip("r", 1.0, "b", "d"), *(clip(f"z{i}", 5.0, "e") for i in range(250))]
    shares = {"a": 3.0, "b": 3.0, "c": 2.9, "d": 2.9, "e": 20.0}
    rows = run_kernel("all", clips, shares, {}, 2.0, selection.Limits(), selection.Weights())
    assert {r[1] for r in rows if r[2] == "selected"} == {"q", "r"} and len(rows) == len(clips)


def test_selection_reserves_every_required_feature(spark, sf, texts):
    eligible = {i: set(t.split(" ")) for i, t in enumerate(texts)}
    held = Counter(w for s in eligible.values() for w in s)
    plan = core.QUERIES["select_greedy"](spark, sf).where("disposition = 'selected'").collect()
    required = {w: min(n, 2) for w, n in held.items() if len(w) == 2}
    assert all(sum(w in eligible[int(r.clip_id)] for r in plan) >= n for w, n in required.items())
    assert {r.selected_reason for r in plan} <= {"coverage", "utility", "exchange"}
