"""Every query of the engine against its SQL in DuckDB, on the smallest data."""

import math

import duckdb
import pytest

from quayside.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    """One form for a value of either engine."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(int(x)) if float(x).is_integer() else f"{x:.9g}"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(r[i]) for i in order] for r in rows)


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = table(df.collect(), df.columns), table(want.fetchall(), want.columns)
    assert len(got) == len(expected)
    assert got == expected
