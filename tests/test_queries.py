"""Every query against its SQL on the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.core.QUERIES])
def test_query(spark, db, name):
    df = entry.core.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = plain([[r[c] for c in names] for r in df.collect()])
    if name not in entry.core.ORACLE_SQL:
        assert got
        return
    want = db.sql(entry.core.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in names]
    assert sorted(want.columns) == names
    assert got == plain([[r[i] for i in at] for r in want.fetchall()])


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    root = Path(entry.__file__).parent
    for p in (root / "koine").rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(entry.__file__).parent
    shutil.copytree(root / "koine", tmp_path / "koine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
