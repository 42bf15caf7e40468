"""Queries against their SQL on rows that the test tables don't have: empty and missing texts, no seconds, odd white space."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.test_queries import plain

TEXTS = ["", None, "  ", "a sil pau b", "x\u00a0y\u3000z w", "one\u000btwo\u0085three", "why?", "why?\n", "why? ", "why?\u3000", "why?\t", "か", "\n", "a b c d", "w " * 20]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of documents, turns and labels."""
    out = tmp_path_factory.mktemp("odd")
    n = len(TEXTS)
    chars = [None if t is None else len(t) for t in TEXTS]
    langs = [None if i == 3 else "ゃ x" if i == 4 else "l\u00a0" if i == 5 else "ja" for i in range(n)]
    documents = {"doc_id": list(range(n)), "text": TEXTS, "lang": langs, "source": [f"s{i % 3}" for i in range(n)], "n_chars": chars}
    documents = {k: v + [n + j for j in range(3)] if k == "doc_id" else v + {"text": ["a b", "", "c"], "lang": ["en"] * 3, "source": [None] * 3, "n_chars": [0, 5, None]}[k] for k, v in documents.items()}
    pq.write_table(pa.table(documents), out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [1, 2], "quality": [0, 1], "toxic": [0, 1]}), out / "labels.parquet")
    turns = {"conv_id": [0] * n, "turn": list(range(n)), "role": ["user"] * n, "text": TEXTS}
    pq.write_table(pa.table(turns), out / "conversations.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["length_band", "feature_bundle", "utterance_type"])
def test_odd_rows(spark, odd, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{odd}/{t}.parquet')")
    df, want = entry.queries()[name](spark, odd), db.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert plain([[r[c] for c in names] for r in df.collect()]) == plain([[r[want.columns.index(c)] for c in names] for r in want.fetchall()])
