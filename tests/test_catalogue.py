"""Every catalogue query against its DuckDB oracle on the small tables."""

import math

import duckdb
import pytest

from tidemark.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations supplier part".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def test_every_query_has_an_oracle():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=str)
    assert got == want
