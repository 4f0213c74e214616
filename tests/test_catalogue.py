"""Every registered query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from colloquy.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5f}"
    return str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns
    assert mine == theirs


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
