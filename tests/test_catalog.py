"""Every driver query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomtext.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "query_id"
    assert set(e.oracle_sql()) <= set(e.queries())
