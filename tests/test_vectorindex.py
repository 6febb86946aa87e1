"""The vector index against brute force: recall, exactness, stale rows, files read, empty and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vectorindex, vectors

SCHEMA = "id long, v array<float>"


def clustered(n=1500, dims=16, groups=20, seed=7):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    v = centre[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, dims))
    v[: n // 3] = v[0]  # a third of all rows are one vector
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(matrix)], SCHEMA).repartition(5)


def brute(keys, matrix, queries, k):
    out = set()
    for q in queries:
        d = 1 - (matrix.astype(np.float64) * q[1].astype(np.float64)).sum(1)
        for i in np.lexsort((keys, d))[:k]:
            out.add((q[0], int(keys[i])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    matrix = clustered()
    return matrix, frame(spark, matrix)


def asked(df):
    return df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))


def test_recall_and_files(spark, data, tmp_path):
    matrix, df = data
    index = vectorindex.build(df, "id", "v", f"file://{tmp_path}/i")
    assert 1 <= index.probes < len(index.centres)
    queries = [(i, matrix[i]) for i in range(0, len(matrix), 50)]
    want = brute(np.arange(len(matrix)), matrix, queries, 10)
    got = {(r.query_id, r.id) for r in vectorindex.search(index, df, "id", "v", asked(df), 10).collect()}
    assert len(got & want) / len(want) >= 0.9
    one = asked(df).where("query_id = 1450")
    cells = vectorindex._cells(index, one.select("query_id", "vector"), lambda c, b: vectorindex._near(c, index.probes))
    every = vectorindex._read(spark, index.path).inputFiles()
    some = {r.f for r in vectorindex._read(spark, index.path).where(F.col("cell").isin([r.cell for r in cells.collect()])).select(F.input_file_name().alias("f")).distinct().collect()}
    assert 0 < len(some) < len(every)
    plan = vectorindex._search(index, cells, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_exact_over_a_stale_index(spark, data, tmp_path):
    """Rows that are new, changed or gone since the index was built; ties go by key."""
    matrix, df = data
    index = vectorindex.build(df.where("id < 1200"), "id", "v", f"file://{tmp_path}/i", cells=30)
    now = matrix.copy()
    now[100:400] = now[700:1000]
    keep = np.array([i for i in range(len(now)) if not 500 <= i < 620])
    live = frame(spark, now).where("not (id >= 500 and id < 620)")
    queries = [(i, now[i]) for i in keep if i % 50 == 0]
    got = vectorindex.search(index, live, "id", "v", asked(live), 7, exact=True).collect()
    assert {(r.query_id, r.id) for r in got} == brute(keep, now[keep], queries, 7)
    again = {(r.query_id, r.id, round(r.distance, 9)) for r in got}
    assert again == {(r.query_id, r.id, round(r.distance, 9)) for r in vectors.nearest(live, asked(live), "id", "v", 7).collect()}


def test_dead_rows_do_not_hide_live_ones(spark, data, tmp_path):
    """All but a few rows of a cell are gone: the search still gives k rows."""
    matrix, df = data
    index = vectorindex.build(df, "id", "v", f"file://{tmp_path}/i", cells=2)
    live = df.where("id % 100 = 0")
    got = vectorindex.search(index, live, "id", "v", asked(live), 5, exact=True)
    assert {r.n for r in got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {5}


def test_odd_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 0.0]), (6, [3.0, 4.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = vectorindex.build(df, "id", "v", f"file://{tmp_path}/a")
    queries = df.where("id is not null").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = sorted((r.query_id, r.id) for r in vectorindex.search(index, df, "id", "v", queries, 5, exact=True).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]
    none = spark.createDataFrame([], SCHEMA)
    empty = vectorindex.build(none, "id", "v", f"file://{tmp_path}/b")
    assert vectorindex.search(empty, none, "id", "v", queries, 5).count() == 0


def test_little_passes_through_the_driver(spark, data, tmp_path):
    """Queries are not broadcast to their cells, and the sample is the same rows, picked from twice as many."""
    matrix, df = data
    index = vectorindex.build(df, "id", "v", f"file://{tmp_path}/i", cells=20)
    cells = vectorindex._cells(index, asked(df), lambda c, b: c > -2)
    found = vectorindex._search(index, cells, 3)
    assert found.count() and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rows = vectorindex._valid(df, "id", "v", 16)
    got = vectorindex.drawn(rows, 1500, 100)
    assert "<= " in got._jdf.queryExecution().analyzed().toString()
    plain = rows.orderBy(F.xxhash64("key"), "key").limit(100).select("vector").collect()
    assert got.collect() == plain and vectorindex.drawn(rows.where("key < 150"), 10**6, 100).count() == 100
