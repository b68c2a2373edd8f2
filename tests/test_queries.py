"""Every registered query against its SQL in DuckDB, on the same files."""

import os

import duckdb
import pytest

from tesselark.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(value):
    return None if value is None or str(value) in ("nan", "<NA>") else value


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["by", "bx", "norm"]
