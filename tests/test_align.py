import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from koine.audio import align as al
from koine.audio.metrics import encode_wav


def plain(e, tokens):
    """The best of all paths, by trying each: its score, and the frames of each token."""
    best = None
    for path in itertools.product([0, *sorted(set(tokens))], repeat=len(e)):
        runs = [(k, [i for i, _ in g]) for k, g in itertools.groupby(enumerate(path), key=lambda x: x[1])]
        if [k for k, _ in runs if k] == list(tokens):
            score = sum(e[f, k] for f, k in enumerate(path))
            if best is None or score > best[0]:
                best = score, [(k, at[0], at[-1]) for k, at in runs if k]
    return best


def emission(rng, frames, symbols=4):
    x = rng.normal(0, 2, (frames, symbols))
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def test_equal_to_trying_all_paths():
    rng = np.random.default_rng(1)
    cases = [(emission(rng, n), t) for n in (1, 2, 3, 5, 6) for t in ([1], [1, 2], [1, 1], [3, 1, 3], [2, 2, 2])]
    for most in (1, 1 << 20):
        found = al.align_lots([e for e, _ in cases], [t for _, t in cases], most=most)
        for (e, t), spans in zip(cases, found, strict=True):
            want = plain(e, t)
            assert (spans is None) == (want is None)
            if want:
                assert [s[:3] for s in spans] == want[1]
                assert spans[0][3] == pytest.approx(np.mean([e[f, t[0]] for f in range(want[1][0][1], want[1][0][2] + 1)]))


def test_what_has_no_path():
    e = np.log(np.full((3, 3), 1 / 3))
    assert al.align([e, e, e, e], [[], [1, 1, 1], [5], [0]]) == [[], None, None, None]
    closed = e.copy()
    closed[:, 1] = -np.inf
    assert al.align([closed, np.full((3, 3), np.nan), np.empty((0, 3))], [[1], [2], [1]]) == [None, None, None]


def test_a_long_text():
    tokens = [1 + i % 3 for i in range(400)]
    e = np.full((1600, 4), -5.0)
    for i, t in enumerate(tokens):
        e[4 * i : 4 * i + 4, t] = -0.1
    assert [s[:3] for s in al.align([e], [tokens])[0]] == [(t, 4 * i, 4 * i + 3) for i, t in enumerate(tokens)]


def test_lots_hold_all_rows_under_the_bound():
    sizes = [(n % 7 + 1, n % 3, 4) for n in range(50)]
    made = list(al.lots(sizes, 1000))
    assert sorted(i for lot in made for i in lot) == list(range(50)) and len(made) > 1
    for lot in made:
        f, t, v = (max(sizes[i][k] for i in lot) for k in range(3))
        assert len(lot) == 1 or len(lot) * f * (8 * v + 2 * t + 1) <= 1000


def test_columns(spark):
    e = [[-0.1, -3.0, -3.0], [-3.0, -0.1, -3.0], [-3.0, -0.1, -3.0], [-3.0, -3.0, -0.1]]
    rows = [(1, e, [1, 2]), (2, e, [1, 1, 1]), (3, None, [1]), (4, e, None), (5, [], [1]), (6, e, []), (7, [[-1.0], [-1.0, -2.0]], [1]), (8, e, [1, None]), (9, [e[0], None], [1])]
    df = spark.createDataFrame(rows, "id int, e array<array<double>>, t array<int>")
    got = {r.id: r for r in df.select("id", al.alignment(F.col("e"), F.col("t")).alias("s"), al.best_path(F.col("e")).alias("b")).collect()}
    assert [tuple(s)[:3] for s in got[1].s] == [(1, 1, 2), (2, 3, 3)] and got[1].b == [1, 2]
    assert [got[i].s for i in (2, 3, 4, 5, 6, 7, 8, 9)] == [None, None, None, None, [], None, None, None] and got[3].b is None and got[5].b == []


def tones(samples, rates):
    """Blank for quiet frames of 100 samples, `low` and `high` by their zero crossings."""
    out = []
    for y in samples:
        frames = y[: len(y) // 100 * 100].reshape(-1, 100)
        loud, turns = np.abs(frames).max(axis=1) > 0.1, (np.diff(np.sign(frames), axis=1) != 0).sum(axis=1)
        kind = np.where(~loud, 0, np.where(turns < 20, 1, 2))
        out.append(np.where(np.arange(3) == kind[:, None], -0.01, -6.0))
    return out


def test_recordings(spark, monkeypatch):
    monkeypatch.setitem(al.EMISSIONS, "tones", (tones, ("", "low", "high"), 0.1))
    t = np.arange(300) / 1000
    y = np.concatenate([np.zeros(200), np.sin(2 * np.pi * 20 * t), np.zeros(100), np.sin(2 * np.pi * 200 * t)]).astype(np.float32) * 0.5
    wav = encode_wav(y, 1000)
    rows = [(1, wav, ["low", "high"], "x"), (2, wav, ["low", "unknown", "high"], "x"), (3, b"broken", ["low"], "x"), (4, None, ["low"], "x"), (5, wav, ["high", "low"] * 9, "x"), (6, wav, [], "x")]
    df = spark.createDataFrame(rows, "id int, content binary, tokens array<string>, token string").repartition(2)
    got = {r.id: r.aligned for r in al.aligned(df, "content", "tokens", "tones").collect()}
    for i in (1, 2):
        assert [(s.token, round(s.start, 3), round(s.end, 3)) for s in got[i]] == [("low", 0.2, 0.5), ("high", 0.6, 0.9)]
    assert got[3] is None and got[4] is None and got[5] is None and got[6] == []
    with pytest.raises(ValueError):
        al.aligned(df, "content", "tokens", "none")


def test_alignments_of_the_test_table(spark, tmp_path):
    """Against a plain table of best scores, state by state."""
    from koine.plans import queries as core

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64).astype(np.float32)], i % 10) for i in range(30)] + [(30, None, 1), (31, [0.0] * 64, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in core.forced_alignment(spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, []).append((r.first, r.last, r.token))
    assert set(got) == set(range(30))
    for i, v, label in rows[:30]:
        e, word = np.array(v, dtype=np.float32).astype(float).reshape(16, 4), [1 + label % 3, 1 + label // 3 % 3, 1 + (label + 1) % 3]
        states = [0, word[0], 0, word[1], 0, word[2], 0]
        best = [[-np.inf] * 7 for _ in range(16)]
        best[0][0], best[0][1] = e[0, 0], e[0, word[0]]
        for f in range(1, 16):
            for s in range(7):
                before = [best[f - 1][s], *([best[f - 1][s - 1]] if s else [])]
                if s > 1 and states[s] and states[s] != states[s - 2]:
                    before.append(best[f - 1][s - 2])
                best[f][s] = max(before) + e[f, states[s]]
        path = [0] * 16
        for a, b, token in got[i]:
            path[a : b + 1] = [token] * (b - a + 1)
        assert [t for _, _, t in sorted(got[i])] == word
        assert sum(e[f, k] for f, k in enumerate(path)) == pytest.approx(max(best[-1][-2:]))
