import numpy as np
import pytest

from koine.operators import neighbors

SCHEMA = "id long, v array<float>, cell string"


def plain(rows):
    """Every row against every row, over the places that both have."""
    out = {}
    for k, a in rows:
        for other, b in rows:
            if None in (k, other, a, b) or k == other:
                continue
            x, y = (np.array([np.nan if e is None or not np.isfinite(e) else e for e in v] or [np.nan], dtype=np.float32).astype(float) for v in (a, b))
            n = min(len(x), len(y))
            d = np.sqrt(np.nansum((x[:n] - y[:n]) ** 2))
            out[k] = min(out.get(k, np.inf), d)
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, v, "extra") for k, v in rows], SCHEMA)
    return {r.id: r.distance for r in neighbors.nearest_all(df, "id", "v", **how).collect()}


def clustered(n, centres, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 10, (centres, 6))
    return [(i, [float(x) for x in middle[i % centres] + rng.normal(0, 0.05, 6)]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"pivots": 3, "block": 4}, {"pivots": 1, "block": 7}])
def test_equal_to_all_pairs(spark, how):
    rows = clustered(150, 9)
    assert found(spark, rows, **how) == pytest.approx(plain(rows), abs=1e-9)


def test_spread_out_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)]) for i in range(120)]
    assert found(spark, rows, block=8) == pytest.approx(plain(rows), abs=1e-9)


def test_copies_repeated_keys_and_a_far_offset(spark):
    rows = [(i, [5e3, 5e3 + (i % 4) * 0.25, 1.0]) for i in range(60)] + [(1, [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0]), (99, [0.0, 0.0, 1.5])]
    assert found(spark, rows, pivots=4, block=5) == pytest.approx(plain(rows), abs=1e-9)


def test_missing_entries_and_other_lengths(spark):
    rows = clustered(40, 4) + [(100, [1.0, None, 3.0, float("nan"), 0.0, 2.0]), (101, [1.0, 2.0]), (102, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (103, None), (None, [0.0] * 6), (104, [1.0] * 8)]
    assert found(spark, rows, block=8) == pytest.approx(plain(rows), abs=1e-9)


def test_empty_and_alone(spark):
    assert found(spark, []) == {} and found(spark, [(1, [1.0, 2.0])]) == {} and found(spark, [(1, None)]) == {}


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "NUMBERS", 60)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(100)]
    assert found(spark, rows, block=6) == pytest.approx(plain(rows), abs=1e-9)


def test_few_meetings_on_clusters(spark, monkeypatch):
    """Vectors sent to parts, for twice and four times the rows in as many clusters: no more than N log N."""
    sent, written = [], neighbors.cut
    monkeypatch.setattr(neighbors, "cut", lambda df, name: (sent.append(df.count()) if name == "met" else None, written(df, name))[1])
    monkeypatch.setattr(neighbors, "NUMBERS", 6 * 64)
    sizes = (300, 600, 1200)
    for n in sizes:
        found(spark, clustered(n, n // 30), block=32)
    assert all(s <= n * np.log2(n) for s, n in zip(sent, sizes, strict=True)), sent
