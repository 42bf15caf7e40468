import hashlib
import random

import pytest

from koine.llm import substring_dedup as sd


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    syllables = ["the", "an", "re", "ß", "é", "ou", "tion", " ", " ", ". "]
    words = lambda n: "".join(rng.choices(syllables, k=n))
    passages = [words(n) for n in (30, 45, 60, 120, 400)]
    rows = []
    for _ in range(docs):
        text = words(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at, cut = rng.randint(0, len(text)), rng.randint(0, len(p) // 3)
            text = text[:at] + p[cut:] + text[at:]
        rows.append(text)
    rows += [rows[3], rows[3], rows[5] + "x", "a" * 350, "b" + "a" * 120, "ab" * 200, "", None, "é" * 99, "short", passages[4] * 5]
    order = list(range(0, 3 * len(rows), 3))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("shard", [1000, 2])
def test_matches_brute_force(spark, monkeypatch, shard):
    """With shards of two segments every level of anchors is used."""
    monkeypatch.setattr(sd, "SHARD", shard)
    rows = corpus(shard)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rk", "'q' as runs").repartition(3)
    assert sorted(tuple(r) for r in sd.substring_report(docs).collect()) == brute(rows)


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(260))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, empty = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    inner = brute([(1, text)])[0]
    got = sorted((tuple(r) for r in sd.substring_report(docs).collect()), key=repr)
    assert got == sorted([inner, inner, (None, 260, 260, 1, empty), (2, 0, 0, 0, empty)], key=repr), whole
    assert sd.substring_report(docs.limit(0)).count() == 0
    assert sd.remove_repeats(docs).columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_bytes"]


def test_shard_arrays_alone():
    import numpy as np

    pieces = [b"z" * 50 + bytes(range(32, 152)), bytes(range(32, 152)), bytes(range(40, 152))]
    owner, first, count = sd.first_windows(pieces, np.array([5, 3, 9]), np.array([0, 0, 0]), np.array([1000, 0, 7]))
    got = {(int(o), int(f) + k) for o, f, n in zip(owner, first, count) for k in range(n)}
    assert got == {(1, k) for k in range(21)} | {(0, k) for k in range(50)}


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    import random as r

    rng = r.Random(2)
    texts = [rng.randbytes(n) for n in (0, 99, 100, 101, 1000, 333)]

    def windows():
        return sorted((int(o), int(f) + k, int(h)) for x in sd.document_segments(texts) for o, h, f, n in zip(x.row, x.hash, x.at, x.count) for k in range(n))

    whole = windows()
    monkeypatch.setattr(sd, "PIECE", 150)
    monkeypatch.setattr(sd, "GROUP", 200)
    assert windows() == whole
    assert [(o, w) for o, w, _ in whole] == [(i, w) for i, t in enumerate(texts) for w in range(max(0, len(t) - 99))]


def test_refined_segments_and_digests():
    import random as r

    texts = [r.Random(i % 4).randbytes(150 + i % 4 * 60) for i in range(8)]
    (found,) = sd.document_segments(texts)
    for level in (0, 1, 2):
        found = found if level == 0 else sd.refined(found, level)
        data, ends = found.texts()
        cut = [data[e - n - 99 : e].tobytes() for e, n in zip(ends, found.count)]
        assert all(texts[o][a : a + n + 99] == c for o, a, n, c in zip(found.row, found.at, found.count, cut))
        assert sorted((int(o), int(a) + k) for o, a, n in zip(found.row, found.at, found.count) for k in range(n)) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)]
        names = dict(zip(cut, sd.digests(found).tolist()))
        assert len(set(names.values())) == len(names) and [names[c] for c in cut] == sd.digests(found).tolist()


def test_what_stays_of_each_text(spark):
    import random as r

    rng = r.Random(12)
    shared = "".join(rng.choice("abcdeé ") for _ in range(300))
    rows = [(i, "".join(rng.choice("fghij ") for _ in range(rng.randrange(200))) + (shared if i % 3 else "") + str(i)) for i in range(12)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as kept", "1 as rk", "2 as doc")
    got = sd.remove_repeats(docs).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept_bytes)).hexdigest()) for x in got) == sorted(brute([(i, t or "") for i, t in rows]))
    assert {x.doc_id: x.text for x in got} == dict(rows) and sum(x.n_removed for x in got) > 1500
