"""Every query with SQL against DuckDB, on the smallest tables; those of the text operators have their own."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

DATA = os.environ.get("LODESTACK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def mismatches(spark, names):
    con, sqls, queries = duck(DATA), entry.oracle_sql(), entry.queries()
    said = [compare(spark, con, n, queries[n], sqls.get(n), DATA) for n in names]
    return [x[:300] for x in said if not x.startswith(("same", "rows"))]


def core_names():
    import importlib

    return [n for m in entry.PLANS for n in importlib.import_module(m).QUERIES]


def test_all_queries_match(spark):
    assert not mismatches(spark, core_names())
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core_names()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
