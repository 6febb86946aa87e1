"""Every core query against its SQL on the smallest tables."""

import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from lodestone.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.5f}" if not value.is_integer() else str(int(value))
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_finds_rows(spark, name):
    """Queries without SQL find rows here, no two alike; what they find is tested by its own tests."""
    found = [tuple(map(str, r)) for r in QUERIES[name](spark, FOLDER).collect()]
    assert found and len(set(found)) == len(found)


def test_chunks_are_all_of_the_texts(spark, duck):
    """Every chunk is that stretch of its text, in order, and what lies between chunks is white space."""
    found = {}
    for r in QUERIES["document_chunks"](spark, FOLDER).collect():
        found.setdefault(r.doc_id, []).append((r.ordinal, r.start, r.end, r.digest))
    for doc_id, text in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        rest, at = "", 0
        for _, start, end, digest in sorted(found.pop(doc_id, [])):
            assert start >= at and hashlib.sha256(text[start:end].encode()).hexdigest() == digest
            rest, at = rest + text[at:start], end
        assert not (rest + text[at:]).strip()
    assert not found
