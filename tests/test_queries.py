"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import math
import os

import duckdb
import pytest
from gatelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.5f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sql.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """A folder with events of which some are zero, and a connection that sees them."""
    at = str(tmp_path_factory.mktemp("zeros"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, CASE WHEN i % 3 = 0 OR i > 7 THEN 'a' ELSE 'b' END AS event_type, CASE WHEN i IN (1, 3) OR i > 8 THEN 0 ELSE i * 1.5 END::DOUBLE AS value FROM range(10) t(i)) TO '{at}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["geometric_means", "xf_log_bases", "xf_log_round_trip"])
def test_zeros_equal_sql(spark, zeros, name):
    at, con = zeros
    df = catalog.QUERIES[name](spark, at)
    got = con.execute(catalog.ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
