import math
from collections import Counter

from koine.llm import toxicity as tox


def test_folding():
    assert tox.fold("") == " " and tox.fold(" \n") == " "
    assert tox.fold("1D10T!") == " idioti "
    assert tox.fold("іdіоt ｉｄｉｏｔ i​diot Ídiòt") == " idiot" * 4 + " "
    assert tox.fold("LOSER l0s3r 1oser") == " ioser ioser ioser "


def naive(folded, lexicon):
    words, out = folded.split(), 0.0
    spared = set()
    for phrase in lexicon.exceptions:
        want = tox.fold(phrase).split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                spared |= set(range(i, i + len(want)))
    for i, w in enumerate(words):
        terms = [t for t in lexicon.terms if w.startswith(t[0])]
        if terms and i not in spared:
            out += max(terms, key=lambda t: len(t[0]))[1]
    return out


def test_matches_agree_with_a_plain_search():
    lexicon = tox.Lexicon((("idiot", 1.0), ("trash", 0.5), ("trashy", 0.75)), ("trash can", "a trash", "clown trash can do"), 1.0, 0.0)
    auto = lexicon.automaton()
    texts = ["", "idiotic idiot", "the trash can is trash", "trashy trash cans", "notidiot", "trash can", "idiot", "clown trash can do", "clown trash can trash", "a trash a trash can trash"]
    for text in texts:
        assert abs(tox.weighted_matches(tox.fold(text), auto) - naive(tox.fold(text), lexicon)) < 1e-9, text


def test_words_with_accents_are_searched_in_both_forms():
    assert tox.prepared("Réeux le rée") == (" reeux ie ree | réeux rée ", 3)
    assert tox.prepared("Re\u0301eux") == (" reeux | réeux ", 1) and tox.prepared("1d10t") == (" idiot ", 1) and tox.prepared("") == (" ", 0)
    auto = tox.Lexicon((("idiot", 1.0), ("réeu", 0.5)), (), 1.0, 0.0).automaton()
    assert [tox.weighted_matches(tox.prepared(t)[0], auto) for t in ("ídïot", "réeuxan", "reeuxan", "RÉEU x")] == [1.0, 0.5, 0.0, 0.5]


def small_corpus():
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = [f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 23)}{chr(97 + i // 26)}{chr(97 + i % 26)}q" for k in range(30)]
        extra = ["grobnak" + chr(97 + i % 26), "you", "zuméx"] if bad else ["grobnak", "tree"] if i % 21 == 1 else ["fine"]
        rows.append((i, " ".join(words[:15] + extra + words[15:])))
        labels.append((i, int(bad)))
    near = [(1000 + i, rows[4][1] + f" tail{i}") for i in range(12)] + [rows[8], (9, rows[9][1])]
    return rows + near, labels + [(i, 1) for i, _ in near[:12]]


def learned_plainly(rows, labels, size=400):
    """The learner as loops: no sketch but full sets of shingles, no Spark."""
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1
    label = {i: x for i, x in labels if not held(i)}
    texts = sorted({(i, t) for i, t in rows if i in label})
    shingles = lambda t: {tuple(tox.fold(t).split()[k : k + 5]) for k in range(max(1, len(tox.fold(t).split()) - 4))}
    kept = []
    for i, t in texts:
        if not any(label[j] == label[i] and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u)) for j, u in kept):
            kept.append((i, t))
    toxic = sum(label[i] for i, _ in kept)
    clean = len(kept) - toxic
    bad, every, docs = Counter(), Counter(), Counter()
    for i, t in kept:
        seen = Counter(w[:n] for w in tox.prepared(t)[0].replace("|", " ").split() for n in range(4, min(12, len(w)) + 1))
        for term, n in seen.items():
            every[term] += min(n, 8)
            bad[term] += min(n, 8) * label[i]
            docs[term] += label[i]
    odds = {x: math.log((bad[x] + 0.5) / (toxic + 1)) - math.log((every[x] - bad[x] + 0.5) / (clean + 1)) for x in every}
    found = {x: (bad[x], odds[x]) for x in every if docs[x] >= max(4, toxic // 50) and odds[x] > 2.5}
    return tox._prune(found, size)


def test_learning_is_that_of_a_plain_learner_and_repeats(spark):
    rows, labels = small_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [tox.learn(docs.repartition(n).orderBy(order), table.repartition(n)) for n, order in ((1, "doc_id"), (7, "text"), (3, tox.F.desc("doc_id")))]
    assert found[0] == found[1] == found[2]
    plain = learned_plainly(rows, labels)
    assert [x for x, _ in found[0].terms] == [x for x, _ in plain]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(found[0].terms, plain))
    assert "grobnak tree" in found[0].exceptions and not any("you" in x for x in found[0].exceptions)
    scores = {r.doc_id: r.predicted for r in tox.score_documents(docs, found[0]).collect()}
    assert all(scores[i] == int(i % 4 == 0) for i in range(240))


def test_learns_and_scores(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}x" for k in range(30)) + (" grobnak" + chr(97 + i % 26) + " zum" if bad else " fine")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "gr0bnаk gr0bnаk"), (1002, "grobnak x"), (1002, "grobnak x"), (1003, "words " * 30000 + "grobnakz")]
    labels += [(1000, None), (None, 1), (7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as score", "'z' as toxic")
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", tox.F.lit("clash"))
    out = tox.toxicity_report(docs, table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    got = {(r.doc_id, r.predicted) for r in out}
    assert all((i, int(i % 4 == 0)) in got for i in range(400))
    assert {(1000, 0), (1001, 0), (None, 1), (1002, 1), (1003, 0)} <= got
    none = tox.toxicity_report(docs, table.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)
    assert tox.toxicity_report(docs.limit(0), table).count() == 0
    kept = tox.score_documents(docs, tox.Lexicon((), (), 1.0, -4.0))
    assert kept.columns == ["doc_id", "text", "toxic", "score", "matched", "predicted"]
