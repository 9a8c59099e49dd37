"""Every query that SQL states too against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or str(value) in ("NaT", "<NA>") or value != value:
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if hasattr(value, "__float__"):
        return f"{float(value):.6g}"
    return str(value)


def cell(value):
    return "[" + ", ".join(map(cell, value)) + "]" if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray" else plain(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted("|".join(map(cell, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(tables.execute(entry.oracle_sql()[name]).fetchdf())
