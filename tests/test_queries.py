"""Every query with SQL agrees with DuckDB on the small tables."""

import datetime
import decimal

import duckdb
import pytest

from sparquill import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(plans.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_is_registered():
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(plans.SQL) <= set(__spark_entry__.oracle_sql())
