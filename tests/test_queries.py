"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import difference, sql_rows, sql_tables

from queries.registry import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return sql_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(name for name, q in REGISTRY.items() if q.sql))
def test_query_equals_sql(spark, connection, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert difference(df.columns, df.collect(), *sql_rows(connection, entry.oracle_sql()[name])) is None


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_every_query_has_sql():
    assert not {name for name, q in REGISTRY.items() if not q.sql}
