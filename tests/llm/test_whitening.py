import math
from fractions import Fraction

import numpy as np
import pytest

from koine.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=8):
    """The definition, by Python's integers."""
    xs = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            xs[i] = [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]
    n, d = len(xs), len(next(iter(xs.values())))
    s = [sum(x[j] for x in xs.values()) for j in range(d)]
    z = {i: [n * x[j] - s[j] for j in range(d)] for i, x in xs.items()}
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in z.values()), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, {i: sum(c * c for c in r) for i, r in z.items()}, {i: np.array(r, dtype=float) / n @ u[:, :components] / np.sqrt(e[:components]) for i, r in z.items()}, e / e.sum(), v


def test_against_the_definition(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.linspace(0.1, 2, 12)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=12) @ mix]) for i in range(300)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (5, rows[5][1])]
    got = wh.whitening_report(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as whitened", "3 as __x").repartition(5)).collect()
    n, deviation, whitened, explained, _ = plain(rows)
    assert n == 302 and len(got) == n * 8 and {r.n for r in got} == {n}
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for i in sorted(deviation):
        mine = by_id[rows[i][0], deviation[i]]
        w = np.array([mine[c + 1][0] for c in range(8)])
        signs = np.sign(w * whitened[i]) if signs is None else signs
        assert np.allclose(w, signs * whitened[i], rtol=1e-9, atol=1e-9)
    assert len(by_id[5, deviation[5]][1]) == 2  # a repeated row counts twice
    for r in got[:8]:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert {type(r.identity_error) for r in got} == {float} and got[0].identity_error < 1e-9


def test_covariance_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(v) * 2.0**43, float(i), 0.0]) for i, v in enumerate([1, -1, 3, 7, -9, 2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    fitted = wh.fit(df)
    assert np.array_equal(fitted.covariance, plain_of_doubles(rows))
    assert wh.whitening_report(df).filter("component = 1 and whitened is null").count() == 0
    assert wh.whitening_report(df).filter("component = 3 and whitened is not null").count() == 0
    assert {r.deviation for r in wh.whitening_report(df).collect()} == {None}  # beyond a long


def plain_of_doubles(rows):
    xs = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    return np.array([[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in xs), n**3)) for b in range(d)] for a in range(d)])


@pytest.mark.parametrize("top", [1 << 10, 1 << 31, 1 << 36, 1 << 54, 1 << 59, 1 << 61])
def test_sums_of_squares(top):
    rng = np.random.default_rng(top & 0xFFFF)
    z = rng.integers(-top, top, size=(500, 3))
    assert wh.summed_squares(z) == [sum(int(v) ** 2 for v in z[:, j]) for j in range(3)]
    assert wh.summed_squares(z.astype(object)) == wh.summed_squares(z)


def test_degenerate_tables(spark):
    report = lambda rows: wh.whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert report([]) == [] and report([(1, None)]) == [] and report([(1, [])]) == []
    alone = report([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone)][:2] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    short = report([(1, [0.5, 0.25]), (2, [1.5, 0.0]), (3, [1.0])])
    assert {r.vec_id for r in short} == {1, 2} and {r.n for r in short} == {2}  # most have two entries
    assert {abs(round(r.whitened, 9)) for r in short if r.component == 1} == {1.0}
