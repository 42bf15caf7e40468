import math

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from koine.llm import token_counts as tc
from koine.llm.bpe import read_ranks

SCORES = {b"a": -2.0, b"b": -2.0, b"ab": -3.0, b"ba": -4.0, b"aba": -4.5, b"abab": -6.0, b"c": -1.0}


def plain(piece, scores):
    best = [(0.0, 0)] + [(-math.inf, -1)] * len(piece)
    for i in range(1, len(piece) + 1):
        for j in range(i):
            if piece[j:i] in scores and best[j][1] >= 0:
                s, n = best[j][0] + scores[piece[j:i]], best[j][1] + 1
                if s > best[i][0] or (s == best[i][0] and n < best[i][1]):
                    best[i] = (s, n)
    return best[-1][1]


def bounded(piece, scores):
    """The same for long pieces: only spans as long as the longest token are tried."""
    longest, best = max(map(len, scores)), [(0.0, 0)]
    for i in range(1, len(piece) + 1):
        found = [(best[j][0] + scores[piece[j:i]], -best[j][1] - 1) for j in range(max(0, i - longest), i) if best[j][1] >= 0 and piece[j:i] in scores]
        s, n = max(found, default=(-math.inf, 1))
        best.append((s, -n))
    return best[-1][1]


def test_long_pieces_match_plain_dynamic_programming():
    import random

    rng = random.Random(1)
    for n in (150, 2000, 20000):
        piece = "".join(rng.choice("abc") for _ in range(n)).encode()
        assert tc.ForwardTrie(SCORES).count(piece) == bounded(piece, SCORES)
        assert n > 200 or bounded(piece, SCORES) == plain(piece, SCORES)


@settings(max_examples=200)
@given(st.lists(st.text(alphabet="abcd", max_size=12), max_size=20))
def test_trie_matches_plain_dynamic_programming(pieces):
    trie = tc.ForwardTrie(SCORES)
    assert [trie.count(p.encode()) for p in pieces] == [plain(p.encode(), SCORES) for p in pieces]


def test_documents(spark, monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    scores = tc.zipf_scores(read_ranks(path))
    splitter = tiktoken.Encoding("split", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = [(1, "the cat's  hat\n\n¿qué? 12"), (2, ""), (3, None), (None, "x"), (3, "again again"), (3, "again again"), (4, "e" * 3000)]
    import regex

    want = []
    for i, t in rows:
        pieces = regex.findall(P.PATTERN, t or "")
        assert sum(len(splitter.encode_ordinary(p)) for p in pieces) == len(splitter.encode_ordinary(t or ""))
        want.append((i, len(pieces), sum(bounded(p.encode(), scores) for p in pieces)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    assert sorted((tuple(r) for r in tc.token_counts(docs, path).collect()), key=repr) == sorted(want, key=repr)
    assert tc.token_counts(docs.limit(0), path).count() == 0
