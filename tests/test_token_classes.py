"""Links of token classes against all pairs, and a token that all rows have."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources.tables import json_lines


@pytest.mark.parametrize("few", [0, 2, 8])
def test_links_are_those_of_all_pairs(spark, few):
    rng = random.Random(few)
    side = lambda n: {k: {"all", *rng.sample("abcdefghij", rng.randint(0, 5))} - ({"all"} if rng.random() < 0.3 else set()) for k in range(n)}
    left, right = side(60), side(80)
    left = {k: v for k, v in left.items() if v}
    frame = lambda held, key: spark.createDataFrame([(k, t) for k, v in held.items() for t in v] * 2, f"{key} long, t string").repartition(4)
    got = {r.left_key: (r.class_id, r.links, r.shared) for r in graph.linked_classes(frame(left, "left_key"), frame(right, "right_key"), "t", few).collect()}
    for k, v in left.items():
        links = [r for r in right.values() if v & r]
        assert got[k] == (min(o for o, w in left.items() if w == v), len(links), sum(len(v & r) for r in links))
    assert len(got) == len(left)


def test_a_token_that_all_rows_have(spark):
    """50,000 and 50,000 classes of their own share one token: their pairs, 2.5 billion, are never made."""
    side = lambda key: spark.range(50_000).select(F.col("id").alias(key), F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id").cast("string")))).alias("t"))
    begin = time.perf_counter()
    found = graph.linked_classes(side("left_key"), side("right_key"), "t").agg(F.min("links").alias("a"), F.max("links").alias("b"), F.sum("shared").alias("c")).first()
    assert tuple(found) == (50_000, 50_000, 50_000 * 50_001) and time.perf_counter() - begin < 100


def test_newest_lines_need_a_limit(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 6)], "i int, at string").write.json(f"{tmp_path}/j")
    rows = lambda **by: [r.i for r in json_lines(spark, f"{tmp_path}/j", "i int, at string", **by).collect()]
    assert rows(newest="at", limit=2) == [5, 4] and sorted(rows()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        rows(newest="at")
