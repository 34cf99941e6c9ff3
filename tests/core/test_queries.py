"""Every query with SQL against DuckDB, and every query against itself on other partitions."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__
from lodestar.plans import catalog, code

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


QUERIES, SQL = catalog.QUERIES | code.QUERIES, catalog.SQL | code.SQL


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([rounded(r[cols.index(c)]) for c in df.columns]) for r in got.fetchall())
    assert sorted(repr([rounded(v) for v in r]) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["search_symbols", "compact_runs", "skeleton_view", "budget_prefix", "symbol_changes"])
def test_partitions_do_not_matter(spark, name):
    runs = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


def test_rows_only(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, SF).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if importlib.util.find_spec("lodestar.llm") is None:
        assert not any(n.startswith("op") for n in __spark_entry__.queries())


def test_nothing_else_needs_the_operators():
    """Only the entry point looks for the training-data subpackage."""
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+lodestar\.llm", p.read_text(), re.M), p
