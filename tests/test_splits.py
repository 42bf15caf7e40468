"""Splits against plain versions and their promises."""

import random
from collections import Counter, defaultdict

import pytest

from koine.operators import components as comp
from koine.operators import split as sp

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
CLIPS = "clip_id string, duration_sec double, features array<string>, audio string, text string"


def plain_components(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for node, key in links:
        if node is None or key is None:
            continue
        a, b = root(node), root(first.setdefault(key, node))
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}


@pytest.mark.parametrize("salt", [100_000, 3])
def test_components(spark, monkeypatch, salt):
    monkeypatch.setattr(comp, "SALT", salt)
    rng = random.Random(salt)
    links = [(rng.randrange(300), rng.randrange(260)) for _ in range(400)] + [(i, 1000 + i) for i in range(500, 560)] + [(i + 1, 1000 + i) for i in range(500, 560)]  # a path of 60
    links += [(i, 5000) for i in range(600, 640)] + [(None, 1), (1, None), (700, 9), (700, 9)]
    got = {r.node: r.component for r in comp.components(spark.createDataFrame(links, "node long, key long").repartition(3)).collect()}
    assert got == plain_components(links)
    assert comp.components(spark.createDataFrame([], "node long, key long")).collect() == []


def plain_deal(items, ratios, order):
    """The rule of deal, item by item; order: the seeded place of each small item."""
    total = sum(s for s, _ in items.values())
    wanted = {s: r * total for s, r in ratios.items() if r > 0}
    have = {s: sum(x for x, held in items.values() if held) * (s == "train") for s in wanted}
    out = {i: "train" for i, (_, held) in items.items() if held}
    for i in sorted((i for i, (s, held) in items.items() if not held and s > total * sp.LARGE), key=lambda i: (-items[i][0], i)):
        out[i] = max(wanted, key=lambda s: (wanted[s] - have[s] - items[i][0], s == "train", s))
        have[out[i]] += items[i][0]
    small = [i for i in order if i not in out]
    lack = {s: max(0.0, wanted[s] - have[s]) for s in wanted}
    left, at = sum(items[i][0] for i in small), 0.0
    ends, upto = [], 0.0
    for s, x in lack.items():
        upto += left * x / sum(lack.values())
        ends.append((upto, s))
    for i in small:
        middle = at + items[i][0] / 2
        out[i] = next((s for e, s in ends[:-1] if middle < e), ends[-1][1])
        at += items[i][0]
    return out


@pytest.mark.parametrize("seed", [0, 5])
def test_dealing(spark, seed):
    rng = random.Random(seed)
    items = {f"i{k:04}": (rng.choice([1.0, 2.0, 5.0, 40.0 if k % 40 == 0 else 3.0]), k % 17 == 0) for k in range(1500)}
    df = spark.createDataFrame([(i, s, h) for i, (s, h) in items.items()], "item string, seconds double, held boolean").repartition(3)
    got = {r.item: r.split for r in sp.deal(df, RATIOS, seed).collect()}
    order = [r.item for r in df.selectExpr("item", f"xxhash64({seed}, item) as h").orderBy("h", "item").collect()]
    assert got == plain_deal(items, RATIOS, order)
    seconds = Counter()
    for i, s in got.items():
        seconds[s] += items[i][0]
    assert all(abs(seconds[s] / sum(seconds.values()) - r) < 0.01 for s, r in RATIOS.items())


def test_dealing_of_few_none_and_held(spark):
    deal = lambda rows, ratios=RATIOS: {r.item: r.split for r in sp.deal(spark.createDataFrame(rows, "item string, seconds double, held boolean"), ratios).collect()}
    assert deal([]) == {} and deal([("a", None, None)]) != {} and deal([("a", 1.0, True)], {"val": 1.0}) == {"a": "train"}
    assert deal([("a", 8.0, None), ("b", 1.0, None), ("c", 1.0, None)]) == {"a": "train", "b": "val", "c": "test"} or set(deal([("a", 8.0, None), ("b", 1.0, None), ("c", 1.0, None)]).values()) == {"train", "val", "test"}


def clips_of(seed, n=1200):
    rng = random.Random(seed)
    return [(f"c{i:04}", rng.choice([1.0, 2.0, 4.0]), ["phone:rare"] if i % 60 == 0 else ["phone:a"], f"a{rng.randrange(1000)}" if i % 9 else None, f"t{rng.randrange(1100)}" if i % 7 else "") for i in range(n)]


@pytest.mark.parametrize("policies", [{"audio": "forbid", "text": "forbid"}, {"audio": "forbid", "text": "forbid_for_test"}, {"audio": "forbid_for_test", "text": "allow"}])
def test_clip_splits_leak_nothing(spark, policies):
    rows = clips_of(len(policies["text"]))
    critical = spark.createDataFrame([("phone", "rare")], "feature_type string, feature string")
    got = {r.clip_id: (r.split, r.warning) for r in sp.seen_speaker(spark.createDataFrame(rows, CLIPS).repartition(4), critical, RATIOS, policies, 3).collect()}
    assert got.keys() == {r[0] for r in rows}
    where = defaultdict(set)
    for clip, _, features, audio, text in rows:
        for d, k in (("audio", audio), ("text", text)):
            if k:
                where[d, k].add(got[clip][0])
        assert "phone:rare" not in features or got[clip][0] == "train"
    for (d, _), splits in where.items():
        assert policies[d] == "allow" or len(splits) == 1 or (policies[d] == "forbid_for_test" and "test" not in splits)
    seconds = Counter()
    for clip, s, *_ in rows:
        seconds[got[clip][0]] += s
    assert all(abs(seconds[s] / sum(seconds.values()) - r) < 0.02 for s, r in RATIOS.items())


def test_a_component_longer_than_its_split(spark):
    rows = [(f"c{i}", 1.0, [], "same" if i < 6 else f"a{i}", None) for i in range(10)]
    none = spark.createDataFrame([], "feature_type string, feature string")
    got = sp.seen_speaker(spark.createDataFrame(rows, CLIPS), none, {"train": 0.3, "val": 0.3, "test": 0.4}, {"audio": "forbid"}).collect()
    hot = {(r.split, bool(r.warning)) for r in got if r.clip_id < "c6"}
    assert len(hot) == 1 and hot <= {("train", False), ("val", True), ("test", True)}
    assert sp.single_speaker(spark.createDataFrame([], "clip_id string, duration_sec double, features array<string>, audio_sha256 string, text_norm string"), RATIOS).collect() == []


def test_protected_speakers_train(spark):
    clips = spark.createDataFrame([(f"s{i % 40}", 10.0 + i) for i in range(400)] + [(None, 5.0)], "speaker_id string, duration_sec double")
    kept = spark.createDataFrame([("s3",), ("s4",), ("zz",), (None,)], "speaker_id string")
    got = {r.speaker_id: r.split for r in sp.unseen_speaker(clips, kept, RATIOS, 1).collect()}
    assert got.keys() == {f"s{i}" for i in range(40)} | {""} and got["s3"] == got["s4"] == got[""] == "train" and set(got.values()) == set(RATIOS)
