import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from koine.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(texts):
    import numpy as np

    return [np.frombuffer(b"".join(row), dtype="<u4").tolist() for row in bpe.encode_texts(texts, bpe.codec(PATH)[0])]


TRICKY = ["", " ", "  ", "a", "'s", " 's", "it's we've I'll 'tis o''s", "a  b\n\n c\t\td \n", "x  y　", "12 34a5 ½²", "'re've'rx 'v", "naïve café 北京 🙂🙂", "---'s '' 'll'", "\r\n \r\n", "a" * 5000, "ab" * 3000 + "  "]


def test_matches_the_library(library):
    assert ids(TRICKY) == [library.encode_ordinary(t) for t in TRICKY]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstmdrevl1a- 　é́"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_texts_match_the_library(texts):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(PATH)[0].ranks, special_tokens={})
    assert ids(texts) == [own.encode_ordinary(t) for t in texts]


def test_round_trip_with_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "null id"), (3, None), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "'x' as n_tokens")
    out = bpe.encode_documents(docs, PATH)
    back = bpe.decode_documents(out, PATH)
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.bytes).decode()) for r in back.collect()) == sorted((i if i is not None else -1, t or "") for i, t in rows)
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0


def test_very_long_texts_match_the_library(library):
    import random

    rng = random.Random(6)
    words = ["the", "naïve", "北京大学", "x1y2", "--", "don't", "🙂", "\n\n", "A" * 40]
    long = " ".join(rng.choice(words) for _ in range(40000))
    assert ids([long, "", long[::-1]]) == [library.encode_ordinary(long), [], library.encode_ordinary(long[::-1])]


def words(n, most, seed=8):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabcdeinorstéß北🙂") for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_new_pieces_are_merged_side_by_side(library, monkeypatch):
    monkeypatch.setattr(bpe, "merge", None)  # one by one: only for pieces that aren't cached
    texts = [" ".join(words(3000, 14, i)) for i in range(3)]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_side_by_side_equals_one_by_one_at_every_length(monkeypatch):
    monkeypatch.setattr(bpe, "LOT", 7)
    pieces = bpe.codec(PATH)[0]
    every = [w.encode()[:n] for n in range(1, bpe.CACHED_BYTES + 1) for w in ["a" * n, "ab" * n, " the" * n, *(x * n for x in words(4, 9, n))]]
    assert {len(p) for p in every} == set(range(1, bpe.CACHED_BYTES + 1))

    found = [np.frombuffer(x, dtype="<u4").tolist() for x in pieces._merge_all(every)]
    whole = [p in pieces.ranks for p in every]
    assert [x for x, w in zip(found, whole, strict=True) if not w] == [bpe.merge(p, pieces.ranks) for p, w in zip(every, whole, strict=True) if not w]


def test_the_cache_starts_anew_and_keeps_no_long_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    pieces = bpe._Pieces(bpe.read_ranks(PATH))
    for i in range(5):
        texts = [" ".join(words(60, 20, i)), "x" * 70 + " " + "x" * 70 + " a"]
        assert [np.frombuffer(b"".join(row), dtype="<u4").tolist() for row in bpe.encode_texts(texts, pieces)] == [library.encode_ordinary(t) for t in texts]
        assert max(map(len, pieces)) <= bpe.CACHED_BYTES and len(pieces) <= 50 + 70


def test_tokens_of_ranks_with_gaps_are_decoded_and_others_refused():
    tokens = bpe._Tokens({b"a": 5, b"bcd": 2, b"e": 9})
    assert tokens.decode(np.array([2, 5, 9, 2]), np.array([0, 1, 1, 4])) == [b"", b"bcd", b"", b"aebcd"]
    assert tokens.decode(np.array([], dtype=np.int64), np.array([], dtype=np.int64)) == []
    for bad in (3, 10):
        with pytest.raises(KeyError):
            tokens.decode(np.array([5, bad]), np.array([2]))
