"""Token lists: splitting, n-grams, boundary marks, positions, keys, substitution and alignment of lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that are no phones, and those of them that match in any case.
EXCLUDED = ("sil", "pau", "sp", "|")
ANY_CASE = ("sil", "pau", "sp")


def split_tokens(text: Column) -> Column:
    """Tokens between white space, empty ones dropped; null gives an empty list."""
    return F.coalesce(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), F.array().cast("array<string>"))


def is_excluded(token: Column, excluded: Sequence[str] = EXCLUDED) -> Column:
    folded = [x for x in excluded if x in ANY_CASE]
    exact = [x for x in excluded if x not in ANY_CASE]
    hit = F.lower(token).isin(folded) if folded else F.lit(False)
    return hit | token.isin(exact) if exact else hit


def phones(text: Column, excluded: Sequence[str] = EXCLUDED) -> Column:
    return F.filter(split_tokens(text), lambda t: ~is_excluded(t, excluded))


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each of which is evaluated once: inside a lambda an expression would be for every element."""
    entry = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(entry), lambda e: f(*[e[f"v{i}"] for i in range(len(values))]))[0]


def ngrams(tokens: Column, n: int, glue: str = "-") -> Column:
    """Runs of n neighbours; an empty list where there are fewer."""

    def runs(t: Column) -> Column:
        most = F.greatest(F.size(t) - (n - 1), F.lit(0))
        shifted = F.arrays_zip(*[F.slice(t, F.lit(k + 1), most).alias(f"t{k}") for k in range(n)])
        return F.transform(shifted, lambda x: F.concat_ws(glue, *[x[f"t{k}"] for k in range(n)]))

    return bound(runs, tokens)


def biphones_with_ends(tokens: Column) -> Column:
    """Bigrams of a list padded with BOS and EOS; an empty list stays empty."""
    padded = F.concat(F.array(F.lit("BOS")), tokens, F.array(F.lit("EOS")))
    return F.when(F.size(tokens) > 0, ngrams(padded, 2)).otherwise(F.array().cast("array<string>"))


def positioned(text: Column, excluded: Sequence[str] = EXCLUDED) -> Column:
    """phone@word_initial, word_medial or word_final of words between `|`; a single phone is both initial and final."""
    words = F.filter(F.transform(F.split(text, r"\|"), lambda w: phones(w, excluded)), lambda w: F.size(w) > 0)

    def place(word: Column) -> Column:
        named = F.transform(
            word,
            lambda t, i: F.concat(t, F.when(i == 0, "@word_initial").when(i == F.size(word) - 1, "@word_final").otherwise("@word_medial")),
        )
        return F.when(F.size(word) == 1, F.array(F.concat(word[0], F.lit("@word_initial")), F.concat(word[0], F.lit("@word_final")))).otherwise(named)

    return F.coalesce(F.flatten(F.transform(words, place)), F.array().cast("array<string>"))


def boundary_marks(text: Column) -> Column:
    """Distinct pauses and word marks in their order, pauses in lower case."""
    found = F.filter(split_tokens(text), lambda t: F.lower(t).isin(*ANY_CASE) | (t == "|"))
    return F.array_distinct(F.transform(found, lambda t: F.when(t == "|", t).otherwise(F.lower(t))))


def down_weighted(text: Column, marked: Sequence[str]) -> Column:
    """Distinct tokens that are among `marked`, in their order; pauses match in any case and come in lower case."""
    if not marked:
        return F.array().cast("array<string>")
    listed = [x.lower() if x.lower() in ANY_CASE else x for x in marked]
    found = F.filter(split_tokens(text), lambda t: is_excluded(t, listed))
    return F.array_distinct(F.transform(found, lambda t: F.when(F.lower(t).isin(*ANY_CASE), F.lower(t)).otherwise(t)))


def keys_of(family: str, tokens: Column) -> Column:
    """Distinct `family:token` keys in their order."""
    return F.transform(F.array_distinct(tokens), lambda t: F.concat(F.lit(f"{family}:"), t))


def family_of(key: Column) -> Column:
    """The family before the first colon; `phone` is another name of `phoneme`, and of keys without one."""
    head = F.when(key.contains(":"), F.substring_index(key, ":", 1)).otherwise("phoneme")
    return F.when(head == "phone", "phoneme").otherwise(head)


def token_of(key: Column) -> Column:
    return F.regexp_replace(key, "^[^:]*:", "")


def substitute(tokens: Column, table: Mapping[str, str]) -> Column:
    """Each mapped token by the tokens of its entry, none for an empty one; others pass."""
    if not table:
        return tokens
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v.split())).cast("array<string>"))]
    found = F.create_map(*pairs)
    return F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(found, t), F.array(t))))


def proportional_pairs(left: Column, right: Column) -> Column:
    """Pairs of each token of left with the token of right at the same share of the list."""

    def pairs(a: Column, b: Column) -> Column:
        n, m = F.size(a), F.size(b)
        pick = lambda i: F.least(m - 1, F.greatest(F.lit(0), F.floor(F.try_divide((2 * i + 1) * m, 2 * n)))).cast("int")
        paired = F.transform(a, lambda x, i: F.struct(x.alias("src"), F.get(b, pick(i)).alias("dst")))
        return F.when((n > 0) & (m > 0), paired).otherwise(F.array().cast("array<struct<src:string,dst:string>>"))

    return bound(pairs, left, right)


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences by bit vectors: a column of the table is two integers of as many bits as the longer
    sequence has elements, and a step of the shorter one a dozen operations on them."""
    if len(a) < len(b):
        a, b = b, a
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    a, b = a[start:], b[start:]
    same = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(b))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not b:
        return len(a)
    where: dict = {x: [] for x in b}
    for i, x in enumerate(a):
        if x in where:
            where[x].append(i)
    at = {}
    for x, places in where.items():
        bits = np.zeros(len(a), dtype=np.uint8)
        bits[places] = 1
        at[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = full, 0, len(a)
    for x in b:
        equal = at[x]
        diagonal = (((equal & up) + up) ^ up) | equal | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        out += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(equal | down | plus)), plus & (equal | down)
    return out


@F.pandas_udf(T.LongType())
def _distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _list_distances(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else distance(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")


def edit_distance(a: Column, b: Column, short: int = 256) -> Column:
    """Edit distance by characters: the JVM's for short texts, by bit vectors for longer ones, where a table of all
    cells would be too much."""
    small = F.greatest(F.length(a), F.length(b)) <= short
    return F.when(small, F.levenshtein(a, b)).otherwise(_distances(F.when(~small, a), F.when(~small, b)))


def token_error_rate(a: Column, b: Column) -> Column:
    """Edit distance of two token lists by the longer one's length: 0 for two empty ones, 1 for one."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(_list_distances(a, b) / longest)


def char_error_rate(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(a, b) / longest)
