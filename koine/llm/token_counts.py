"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

Texts fall into pre-tokens as the byte-level pattern cuts them. Distinct pre-tokens go into a trie; a node holds the
best score of its prefix and the number of tokens of that segmentation, computed once when the node is made from
those of its ancestors, whatever number of pre-tokens run through it. The node where a pre-token ends is its count.
The vocabulary is read backwards from the new byte, in a trie of its own, so only tokens that fit are tried.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from koine.llm.bpe import piece_starts, read_ranks
from koine.llm.common import ship, text_slices, texts_of

#: Nodes of a trie, and cached pre-tokens, before it starts anew.
NODES, CACHED = 400_000, 300_000


def zipf_scores(ranks: Mapping[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of the tokens of a rank file, by Zipf's law: in proportion to 1 / (rank + 2)."""
    total = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {token: -math.log(r + 2) - total for token, r in ranks.items()}


class ForwardTrie:
    """Best segmentations of byte strings by their prefixes. Ties go to fewer tokens."""

    def __init__(self, scores: Mapping[bytes, float]):
        self.back: dict[int, int] = {}  # state * 256 + byte to state, from the end of a token to its start
        self.ends: list[float | None] = [None]
        for token, score in scores.items():
            state = 0
            for byte in reversed(token):
                step = state << 8 | byte
                if step not in self.back:
                    self.back[step] = len(self.ends)
                    self.ends.append(None)
                state = self.back[step]
            if token:
                self.ends[state] = score
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def count(self, piece: bytes) -> int:
        """Tokens of the best segmentation; -1 where the vocabulary can't spell the piece."""
        if len(self.best) >= NODES:
            self.clear()
        children, best, tokens, back, ends = self.children, self.best, self.tokens, self.back, self.ends
        path, node = [0], 0
        for i, byte in enumerate(piece):
            step = node << 8 | byte
            node = children.get(step)
            if node is None:
                top, fewest, state = -math.inf, -1, 0
                for j in range(i, -1, -1):
                    state = back.get(state << 8 | piece[j])
                    if state is None:
                        break
                    if (score := ends[state]) is not None and tokens[path[j]] >= 0:
                        score, n = best[path[j]] + score, tokens[path[j]] + 1
                        if score > top or (score == top and n < fewest):
                            top, fewest = score, n
                node = children[step] = len(best)
                best.append(top)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]


class _Counts(dict):
    def __init__(self, trie: ForwardTrie):
        self.trie = trie

    def __missing__(self, piece: bytes) -> int:
        n = self.trie.count(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(ForwardTrie(zipf_scores(read_ranks(path))))


def count_texts(texts: list[str], counts: Mapping[bytes, int]) -> list[tuple[int, int]]:
    """Pre-tokens and tokens of each text."""
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    begins = piece_starts(codes, first[lengths > 0])
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    data = whole.encode()
    cuts = [*(np.cumsum(width) - width)[begins].tolist(), len(data)]
    sums = np.concatenate([[0], np.cumsum([counts[data[a:b]] for a, b in pairwise(cuts)], dtype=np.int64)])
    at = np.searchsorted(begins, np.append(first, len(codes)))
    return list(zip(np.diff(at).tolist(), np.diff(sums[at]).tolist(), strict=True))


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_tokens of documents(doc_id, text) under the rank file at `path`, scored by Zipf's law.

    Null and empty texts have none of either. Repeated rows and null ids come out as they come in; other columns are
    ignored. Empty table: no rows. Nothing is shuffled; memory is bounded by the longest text and the trie's bound.
    """
    ship(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = _counts(path)
        for batch in batches:
            for part in text_slices(batch):
                rows = count_texts(texts_of(part), counts)
                pieces, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pieces", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_pieces long, n_tokens long")
