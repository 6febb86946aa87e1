"""Capped counts and hydration: what a hot chunk ships, limits, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks


@pytest.mark.parametrize(("limit", "held"), [(0, 10**6), (2, 10**6), (2, 3), (50, 5)])
def test_capped_counts(spark, limit, held):
    rng = random.Random(3)
    rows = [("hot", i) for i in range(300)] + [(f"c{rng.randint(0, 40)}", rng.randint(0, 9)) for _ in range(600)] + [(None, 1), ("x", None), ("hot", 1)]
    df = spark.createDataFrame(rows, "chunk string, parent long").repartition(6)
    want = {}
    for c, p in rows:
        if c is not None and p is not None:
            want.setdefault(c, set()).add(p)
    got = {r.chunk: r.n for r in chunks.capped_counts(df, "chunk", "parent", limit, held).collect()}
    assert got == {c: min(len(p), limit + 1) for c, p in want.items()}
    assert chunks.capped_counts(df.where("parent > 999"), "chunk", "parent", limit).count() == 0


def test_a_hot_chunk_ships_few_rows(spark):
    """A chunk in 100,000 parents passes on limit + 1 of them from each task."""
    df = spark.range(100_000, numPartitions=4).select(F.lit("hot").alias("chunk"), F.col("id").alias("parent"))
    plan = chunks.capped_counts(df, "chunk", "parent", 3)
    assert plan.collect()[0].n == 4
    metrics = plan._jdf.queryExecution().executedPlan()
    stack, shipped = [metrics], []
    while stack:
        node = stack.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            shipped.append(node.metrics().apply("shuffleRecordsWritten").value())
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            stack.append(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            stack.append(node.plan())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    assert shipped and max(shipped) <= 4 * 4


def test_hydration(spark):
    rows = spark.createDataFrame([("a", "item", 1, "x"), ("b", "source", 1, "y"), ("c", "item", 2, "z"), ("d", "item", None, "w")], "chunk_id string, kind string, parent long, text string")
    items = spark.createDataFrame([("item", 1, "n", True, "A"), ("item", 2, " ", True, "B")], "kind string, parent long, note string, current boolean, title string")
    sources = spark.createDataFrame([("source", 1, "n", None, "S")], items.schema)
    ids = spark.createDataFrame([(" a",), ("a",), ("",), (None,), ("b",), ("c",), ("d",), ("zz",)], "chunk_id string")
    assert [(r.chunk_id, r.title) for r in chunks.hydrated(ids, rows, [items, sources]).collect()] == [("a", "A")]
    assert [(r.chunk_id, r.title) for r in chunks.hydrated(ids, rows, [items, sources.fillna(True)]).collect()] == [("a", "A"), ("b", "S")]
    with pytest.raises(ValueError):
        chunks.hydrated(ids, rows, [items], most=2)
    assert chunks.hydrated(ids.limit(0), rows, [items]).count() == 0
