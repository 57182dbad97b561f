import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "l_returnflag", "rows", "share"] and df.count() == 6


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.count()
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        assert sorted(df.columns) == sorted(d[0] for d in result.description)
        assert rows == len(result.fetchall())
