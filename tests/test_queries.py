import os

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if v is None or isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir)
    expected = duck.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(repr([norm(r[c]) for c in columns]) for r in found.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in expected.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
