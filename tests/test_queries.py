"""Every registered query against its SQL counterpart on the smallest sample."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables(sample):
    con = duckdb.connect()
    for path in glob.glob(f"{sample}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sample, tables):
    df = QUERIES[name](spark, sample)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        result = tables.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(columns, result.fetchall())
