"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return out


def plain(v):
    return round(v, 7) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    want = rows(got.columns, got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named():
    assert set(entry.oracle_sql()) <= set(entry.queries())
