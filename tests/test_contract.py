"""The driver contract: entry() on sf0.001 and every oracle key against
DuckDB at sf0.001 (the driver itself checks sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert rows and set(df.columns) == {"rank", "song_id", "song_name", "artist_name", "similarity"}


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_oracle_agrees(spark, duck, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(srows, df.columns) == _rows(drows, rel.columns)
