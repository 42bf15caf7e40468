import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from koine.llm import suffix_array as sx


def plain(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120), st.sampled_from([0, 1, 8, 1000]))
def test_suffix_array_is_sorted(values, mean):
    s = [*values, 0]
    old, sx.MEAN_BUCKET = sx.MEAN_BUCKET, mean
    try:
        assert sx.suffix_array(np.array(s)).tolist() == plain(s)
    finally:
        sx.MEAN_BUCKET = old


def test_runs_and_repeats():
    rng = random.Random(5)
    for s in ([1] * 300, [1, 2] * 200, [2, 1] * 200, [rng.randint(1, 3) for _ in range(40)] * 12, list(range(300, 0, -1)), list(range(1, 300))):
        assert sx.suffix_array(np.array([*s, 0])).tolist() == plain([*s, 0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.sampled_from([5, 8, 20, 200]))
def test_common_prefixes(values, limit):
    s = np.array([*values, 0])
    sa = sx.suffix_array(s)
    got = sx.permuted_common_prefixes(s, sa, limit)
    for r in range(1, len(sa)):
        a, b, k = sa[r - 1], sa[r], 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert got[b] == min(k, limit)
    assert all(got[i] >= got[i - 1] - 1 for i in range(1, len(s)))
