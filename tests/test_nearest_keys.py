"""Allowed keys within two edits, against all pairs, and how many rows meet."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("size", [2, 4, 7])
def test_equals_all_pairs(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("aB,:1") for _ in range(rng.randint(0, size)))
    wanted = {rng.choice(("n:", "N:", "m:", "")) + word() for _ in range(150)}
    allowed = {rng.choice(("n:", "m:", "")) + word() for _ in range(60 if size > 2 else 8)}
    want = set()
    for k in wanted:
        low = k.lower()
        near = [(distance(low, a.lower()), a) for a in allowed if a.lower().split(":")[0] == low.split(":")[0]]
        want |= {(k, a, d) for d, a in [min(near)] if d <= 2} if near else set()
    frame = lambda keys: spark.createDataFrame([(k,) for k in [*keys, None]], "key string")
    got = evidence.nearest_keys(frame(wanted), frame(allowed)).collect()
    assert {(r.key, r.near, r.distance) for r in got} == want and len(got) == len(want)
    assert {r.distance for r in got} == {0, 1, 2}


def test_numbers_make_no_pairs(spark, monkeypatch):
    """Numbers of five digits are within two edits of thousands of others: keys that have an equal one meet nothing else."""
    asked = []
    real = evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df, name: asked.append((name, out := real(df, name))) or out)
    keys = lambda add: spark.range(10_000, 30_000).select(F.concat(F.lit("c:"), F.col("id") + add).alias("key"))
    got = evidence.nearest_keys(keys(150), keys(0))
    assert {r.distance: r["count"] for r in got.groupBy("distance").count().collect()} == {0: 19_850, 1: 150}
    assert sum(df.count() for name, df in asked if name == "asked") <= 150 * 20
