"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding brings look-alikes together: compatibility forms are stripped, homoglyphs of other scripts and digits or signs
that stand for letters become those letters, i and l (and what stands for either) are one letter. Words are matched
without their accents, and words that have accents also with them: an insult in disguise is found by the first form, a
language that tells words apart by accents needs the second. Terms are matched at the start of words. A match inside an
exception phrase doesn't count. Terms, weights and exception phrases are learned from labelled documents; so is the
logistic curve from weighted matches per word to a probability. What is learned depends on the rows alone, not on how
they are dealt out or in which order they come.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, ship, text_slices, texts_of
from koine.llm.minhash import BANDS, SLOTS, band_keys, shingle_sets, signatures

#: Letters of other scripts by the Latin letters they look like.
HOMOGLYPHS = {
    "a": "аɑα", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιıӏ", "j": "јϳ", "k": "кκ", "m": "м",
    "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Characters that show nothing and part no word.
HIDDEN = "­​‌‍⁠﻿"
#: Words added to a length, so that one match in a short text isn't everything.
PRIOR_WORDS = 20
#: Letters of a term, fewest and most; occurrences of a term in one document that count for its weight.
TERM, OFTEN = (4, 12), 8
#: Share of the sketch's slots in which near copies agree.
ALIKE = 0.8
#: Log odds that a term needs.
LEAST_ODDS = 2.5


class _Fold(dict):
    """Code point to folded text, filled as code points turn up; accents go unless they are kept."""

    def __init__(self, accents: bool):
        super().__init__()
        self.accents = accents

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HIDDEN:
            out = ""
        else:
            parts = [x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)]
            out = "".join(map(_letter, parts))
            if self.accents and c.isalpha() and len(parts) == 1 and (kept := c.casefold()) not in _PLAIN and len(kept) == 1 and unicodedata.decomposition(kept):
                out = unicodedata.normalize("NFKC", kept)
        self[code] = out
        return out


_PLAIN = {x: latin for latin, others in HOMOGLYPHS.items() for x in others} | DIGITS


def _letter(c: str) -> str:
    c = _PLAIN.get(c, c)
    return "i" if c == "l" else c if c.isalpha() else " "


_FOLD, _FOLD_ACCENTS = _Fold(False), _Fold(True)


def fold(text: str) -> str:
    """The folded words of a text, each between single spaces; a space for no words."""
    return " ".join(["", *text.translate(_FOLD).split(), ""]) or " "


def prepared(text: str) -> tuple[str, int]:
    """What is searched: the folded words and, after a bar, those that have accents with them; the number of words."""
    plain = text.translate(_FOLD).split()
    words = " ".join(["", *plain, ""]) or " "
    if text.isascii():
        return words, len(plain)
    accented = unicodedata.normalize("NFC", text).translate(_FOLD_ACCENTS).split()
    tail = [b for a, b in zip(plain, accented) if a != b] if len(plain) == len(accented) else [b for b in accented if not b.isascii()]
    return (words + " ".join(["|", *tail, ""]) if tail else words), len(plain)


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the curve: probability = 1 / (1 + exp(-(slope * x + offset)))."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    offset: float

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term, weight in self.terms:
            auto.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            key = fold(phrase)
            auto.add_word(key, (len(key), -1.0))
        auto.make_automaton()
        return auto


def weighted_matches(folded: str, auto) -> float:
    """Sum of weights over words that start with a term, outside exception phrases; the longest term of a word counts."""
    if not len(auto):
        return 0.0
    found, spared = {}, []
    for end, (size, weight) in auto.iter(folded):
        if weight < 0:
            spared.append((end - size + 1, end))
        else:
            found[end - size + 1] = weight  # a longer term at the same start comes later
    if not spared:
        return sum(found.values())
    spared.sort()
    total, reach, k = 0.0, -1, 0
    for at in sorted(found):  # both lists in order: one walk
        while k < len(spared) and spared[k][0] <= at:
            reach, k = max(reach, spared[k][1]), k + 1
        total += found[at] * (at >= reach)
    return total


def features(text: str, auto) -> float:
    folded, n = prepared(text)
    return math.log1p(100 * weighted_matches(folded, auto) / (n + PRIOR_WORDS))


def held_out() -> Column:
    """Whether labels of a row must not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled ids of each label, those with the smallest hashes."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = None
    for label in (0, 1):
        some = usable.filter(F.col("toxic") == label).orderBy(*order).limit(most)
        ids = some if ids is None else ids.unionByName(some)
    ids = cut(ids, "toxic-ids")  # at most 2 * most rows of 12 bytes
    found = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.select("doc_id", F.xxhash64("text").alias("of_text"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id", "of_text"])


def _sketched(batches):
    """For each sampled text its signature in bands."""
    for batch in batches:
        for part in text_slices(batch):
            keys = band_keys(signatures(shingle_sets([fold(t) for t in texts_of(part)], 5)))
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            columns = [part.column(c) for c in ("doc_id", "of_text", "toxic")]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["doc_id", "of_text", "toxic", "bands"])


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample without near copies: a text goes if the first of one of its buckets, in the order of hashed ids, has its
    label and agrees with it in ALIKE of the sketch. The order is fixed, so the same rows stay however they are dealt."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    sketches = cut(sample.mapInArrow(_sketched, f"doc_id {kind}, of_text long, toxic int, bands array<long>"), "toxic-sketches")
    me = F.struct(F.xxhash64("doc_id").alias("rank"), "doc_id", "of_text", "bands")
    placed = sketches.select("toxic", me.alias("me"), F.posexplode("bands").alias("band", "key"))
    first = placed.groupBy("toxic", "band", "key").agg(F.min("me").alias("first"))
    slots = lambda x, y: sum(((F.shiftright(x.bitwiseXOR(y), 16 * k).bitwiseAND(F.lit(0xFFFF))) == 0).cast("int") for k in range(SLOTS // BANDS))
    agreed = F.aggregate(F.zip_with("me.bands", "first.bands", slots), F.lit(0), lambda a, x: a + x)
    copies = placed.join(first, ["toxic", "band", "key"]).filter((F.col("me") != F.col("first")) & (agreed >= ALIKE * SLOTS))
    return sample.join(copies.select("me.doc_id", "me.of_text").distinct(), ["doc_id", "of_text"], "left_anti")


def _term_counts(batches):
    """For each text its label and its words' starts, each with its number, OFTEN at most."""
    low, high = TERM
    for batch in batches:
        for part in text_slices(batch):
            toxic, terms, counts, ends = part.column("toxic"), [], [], [0]
            for text in texts_of(part):
                seen: dict[str, int] = {}
                for word, n in Counter(prepared(text)[0].replace("|", " ").split()).items():
                    for k in range(low, min(len(word), high) + 1):
                        seen[word[:k]] = seen.get(word[:k], 0) + n
                terms += seen
                counts += [min(n, OFTEN) for n in seen.values()]
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "n"])
            yield pa.RecordBatch.from_arrays([toxic, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["toxic", "terms"])


def _contexts(terms: tuple[tuple[str, float], ...]):
    """For each text its label and the phrases around its matches: the word, and the word with each neighbour."""

    def run(batches):
        auto = Lexicon(terms, (), 1.0, 0.0).automaton()
        for batch in batches:
            for part in text_slices(batch):
                phrases = []
                for text in texts_of(part):
                    folded, found = prepared(text)[0], set()
                    starts = {end - size + 1 for end, (size, _) in auto.iter(folded)} if len(auto) else ()
                    for at in starts:
                        stop = folded.index(" ", at + 1)
                        found.add(folded[at : stop + 1])
                        if (after := folded.find(" ", stop + 1)) > 0:
                            found.add(folded[at : after + 1])
                        if at and (before := folded.rfind(" ", 0, at)) >= 0:
                            found.add(folded[before : stop + 1])
                    phrases.append(sorted(x for x in found if "|" not in x))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(phrases, pa.list_(pa.string()))], ["toxic", "phrases"])

    return run


def learn(documents: DataFrame, labels: DataFrame, most: int = 6000, size: int = 400, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from labels(doc_id, toxic) of rows that aren't held out.

    most: bound on the labelled documents of each label that are read (near copies of one another count once). size:
    bound on terms, and on exception phrases; `exceptions` are added to those learned. A term is a word start of 4 to 12
    letters that toxic documents have far more often than others; an exception phrase is a match with or without a
    neighbouring word that others have and toxic ones hardly do. With no usable label, or none of one kind, nothing is
    matched and every score is that of no match. Reruns learn the same, in whatever order the rows come.
    """
    ship(documents.sparkSession)
    sample = cut(_sample(documents, labels, most), "toxic-sample")
    sample = cut(_without_copies(sample), "toxic-distinct")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon((), exceptions, 1.0, -4.0)
    rate = lambda bad, good: F.log((bad + 0.5) / (toxic + 1)) - F.log((good + 0.5) / (clean + 1))
    rows = sample.select("toxic", "text").mapInArrow(_term_counts, "toxic int, terms array<struct<term:string,n:int>>")
    counts = rows.select("toxic", F.inline("terms")).groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    odds = rate(F.col("bad"), F.col("n") - F.col("bad"))
    best = counts.filter((F.col("t") >= max(4, toxic // 50)) & (odds > LEAST_ODDS)).select("term", "bad", odds.alias("odds"))
    best = best.orderBy(F.desc(F.col("bad") * F.col("odds")), "term").limit(20 * size).collect()  # bounded by size
    terms = _prune({r.term: (r.bad, r.odds) for r in best}, size)

    around = sample.select("toxic", "text").mapInArrow(_contexts(terms), "toxic int, phrases array<string>")
    around = around.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    spare = around.filter((F.col("n") - F.col("t") >= max(3, clean // 2000)) & (rate(F.col("t"), F.col("n") - F.col("t")) < -LEAST_ODDS / 2))
    spare = spare.orderBy(F.desc(F.col("n") - F.col("t")), "phrase").limit(size).collect()  # bounded by size
    exceptions = tuple(sorted({*exceptions, *(r.phrase.strip() for r in spare)}))

    lexicon = Lexicon(terms, exceptions, 1.0, 0.0)
    scored = sample.select("toxic", "text").mapInArrow(_feature_rows(lexicon), "toxic int, x double").collect()  # bounded by most
    scored = np.array(sorted((r.x, r.toxic) for r in scored), dtype=float)
    slope, offset = _logistic(scored[:, 0], scored[:, 1])
    return Lexicon(terms, exceptions, slope, offset)


def _prune(found: dict[str, tuple[int, float]], size: int) -> tuple[tuple[str, float], ...]:
    """Of terms that begin alike and occur alike the longest; of the rest those that no shorter kept one covers."""
    kept: dict[str, float] = {}
    longest = {}
    for term, (t, _) in sorted(found.items()):
        for n in range(TERM[0], len(term)):
            if (head := term[:n]) in found and t >= 0.9 * found[head][0]:
                longest[head] = max(longest.get(head, ""), term, key=len)
    for term in sorted(found, key=lambda x: (-found[x][0] * found[x][1], x)):
        term = longest.get(term, term)
        if term not in kept and not any(term[:n] in kept for n in range(TERM[0], len(term))):
            kept[term] = min(1.0, found[term][1] / 6)
        if len(kept) >= size:
            break
    return tuple(sorted(kept.items()))


def _feature_rows(lexicon: Lexicon):
    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            for part in text_slices(batch):
                x = [features(t, auto) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on a weighted likelihood with a weak prior; both labels weigh the same."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta, prior = np.zeros(2), np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + prior, design.T @ (weight * (y - p)) - prior @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def score_documents(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """documents(doc_id, text, ...) with all their columns and score, matched, predicted added.

    Null and empty texts have no match and so the score of none. Repeated rows and null ids are scored like any other
    row; columns of these names in the input are replaced. Empty table: no rows.
    """
    ship(documents.sparkSession)
    base = documents.drop("score", "matched", "predicted")

    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            for part in text_slices(batch):
                folded = [prepared(t) for t in texts_of(part)]
                hits = [weighted_matches(t, auto) for t, _ in folded]
                x = np.log1p([100 * h / (n + PRIOR_WORDS) for h, (_, n) in zip(hits, folded, strict=True)])
                score = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -30, 30)))
                more = [pa.array(score), pa.array(hits, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "score", "matched", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{fields}, score double, matched double, predicted int")


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    lexicon = learn(documents, labels)
    return score_documents(documents.select("doc_id", "text"), lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
