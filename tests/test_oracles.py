"""Every query with SQL gives the rows that DuckDB gives for it, over whole tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if value is not None and not isinstance(value, (str, int, bool)):
        try:
            return round(float(value), 6)
        except (TypeError, ValueError):
            return str(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    expected = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got.columns, got.collect()), rows(expected.columns, expected.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    assert a or name in ("resume_antijoin",)
