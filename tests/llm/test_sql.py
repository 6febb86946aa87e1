"""Queries of this package against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df, want = QUERIES[name](spark, FOLDER), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
