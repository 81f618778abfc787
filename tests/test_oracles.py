"""Every query with an oracle against DuckDB on the smallest tables; the others run."""

import datetime
import decimal
import math

import duckdb
import pytest

from tallyforge.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:10]
    return value


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    wanted = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert ordered([tuple(r) for r in found.collect()], found.columns) == ordered(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())
