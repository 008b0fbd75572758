"""Registered queries against their SQL at the smallest scale, and the shape of the package."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import evidence, queries, studies  # noqa: F401  (they register)
from quillspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    show = lambda v: repr(round(v, 9) if isinstance(v, float) else v)
    mine = sorted(tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect())
    theirs = sorted(tuple(show(v) for _, v in sorted(zip(want.columns, r))) for r in want.fetchall())
    assert mine == theirs


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "start", "end", "words", "line", "column"] and df.count() == 1058


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
