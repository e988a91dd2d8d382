"""Registered engine queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from clonespark import operator_queries, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def test_all_are_registered():
    assert len(queries.QUERIES) > 100 and operator_queries.junction_analysis is queries.QUERIES["junction_analysis"]


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(sql.sql(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
