"""The driver contract."""

from __future__ import annotations

import __spark_entry__ as entry
from symtrace.plans import queries as core


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "src_func_name" in df.columns


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(core.QUERIES) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(s.strip() for s in sql.values())
