"""Vectors: checks, exact cosine search, diversity, segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.windows import cap_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid(v: Column, dims: int, slack: float = 1e-3) -> Column:
    """Right size, finite, of unit length."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dims) & finite & (F.abs(norm(v) - 1) <= slack)


def query_blocks(queries: DataFrame, size: int) -> list[list]:
    """Rows of `queries` (query_id, vector) in blocks of about `size`, read one block at a time: a block is all that the driver holds."""
    blocks = -(-queries.count() // size)
    at = F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1)))
    return (sorted(queries.where(at == i).collect(), key=lambda r: r.query_id) for i in range(blocks))


def distances(vectors: DataFrame, queries: DataFrame, columns: list[str], vector: str, block: int = 1024) -> DataFrame:
    """(query_id, columns, distance): 1 - dot of each row with each query of a stated list, block after block; to be cut by rank at once."""
    spark, out = vectors.sparkSession, None
    for rows in query_blocks(queries, block):
        probe = F.broadcast(spark.createDataFrame(rows, queries.select("query_id", "vector").schema))  # `block` rows
        more = vectors.crossJoin(probe).select("query_id", *columns, (1 - dot(F.col(vector), F.col("vector"))).alias("distance"))
        out = more if out is None else out.union(more)
    return out if out is not None else vectors.select(F.lit(0).cast("long").alias("query_id"), *columns, F.lit(0.0).alias("distance")).limit(0)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, key, distance): exact top k by 1 - dot, ties by key, for a stated list of queries (query_id, vector).

    Queries go to all tasks in blocks of about `block`. Each task multiplies its vectors with a block and keeps k for each query, so only k rows
    for each task and query are shuffled.
    """
    found = None
    for rows in query_blocks(queries, block):
        more = _nearest(vectors, rows, key, vector, k)
        found = more if found is None else found.union(more)
    if found is None:
        found = vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(key).cast("long"), F.lit(0.0).alias("distance")).limit(0)
    return cap_per_group(found, ["query_id"], [F.asc("distance"), F.asc(key)], k)


def best_rows(query: np.ndarray, rows: np.ndarray, keys: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of the k nearest rows, ties by key. `rough` distances come from a block product, whose last bits depend on a row's
    place there; rows as near as the k-th or nearly so are measured again, each by itself, so that equal vectors are equally far."""
    if len(rough) > k:
        near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9)
    else:
        near = np.arange(len(rough))
    distance = 1 - (rows[near] * query).sum(1)
    order = np.lexsort((keys[near], distance))[:k]
    return near[order], distance[order]


def _nearest(vectors: DataFrame, rows: list, key: str, vector: str, k: int, step: int = 64) -> DataFrame:
    ids, matrix = [r.query_id for r in rows], np.array([list(r.vector) for r in rows], np.float64)

    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in batches:
            if not len(part):
                continue
            names = part.column(0).to_numpy(zero_copy_only=False)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            for at in range(0, len(ids), step):
                for i, rough in enumerate(1 - matrix[at : at + step] @ flat.T, at):
                    rows, d = best_rows(matrix[i], flat, names, rough, k)
                    n = names[rows]
                    if i in kept:
                        d, n = np.concatenate([kept[i][0], d]), np.concatenate([kept[i][1], n])
                        order = np.lexsort((n, d))[:k]
                        d, n = d[order], n[order]
                    kept[i] = (d, n)
        for i, (d, n) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.float64())], names=["query_id", key, "distance"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, f"query_id long, {key} long, distance double")


def nearest_capped(vectors: DataFrame, queries: DataFrame, key: str, group: str, vector: str, each: int, k: int, block: int = 4096) -> DataFrame:
    """(query_id, key, group, distance): exact top k by 1 - dot, ties by key, with at most `each` of a group, for a stated list of queries (query_id, vector).

    Each task multiplies blocks of its vectors with a block of queries and keeps for each query what is among its own k best by the same
    rule: a row that this leaves out has k better ones, and a better one of the same group for any of these that goes later.
    """
    found = None
    for rows in query_blocks(queries, block):
        more = _nearest_capped(vectors, rows, key, group, vector, each, k)
        found = more if found is None else found.union(more)
    if found is None:
        found = vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(key).cast("long"), group, F.lit(0.0).alias("distance")).limit(0)
    order = [F.asc("distance"), F.asc(key)]
    return cap_per_group(cap_per_group(found, ["query_id", group], order, each), ["query_id"], order, k)


def capped(distance: np.ndarray, keys: np.ndarray, groups: np.ndarray, each: int, k: int) -> np.ndarray:
    """Places of the k best by distance and key with at most `each` of a group, best first."""
    order = np.lexsort((keys, distance))
    by_group = order[np.argsort(groups[order], kind="stable")]
    g = groups[by_group]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    keep = np.zeros(len(distance), bool)
    keep[by_group[rank < each]] = True
    return order[keep[order]][:k]


def _nearest_capped(vectors: DataFrame, rows: list, key: str, group: str, vector: str, each: int, k: int, step: int = 128, first: int = 256) -> DataFrame:
    ids, matrix = [r.query_id for r in rows], np.array([list(r.vector) for r in rows], np.float64)

    def run(batches):
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        bound = np.full(len(ids), np.inf)  # the k-th distance so far
        numbers, kind = {}, pa.null()  # of the groups that the task has met
        for part in batches:
            if not len(part):
                continue
            names, kind = part.column(0).to_numpy(zero_copy_only=False), part.column(1).type
            own = np.array([numbers.setdefault(x, len(numbers)) for x in part.column(1).to_pylist()], np.int64)
            flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)

            def take(i: int, near: np.ndarray) -> None:
                exact = 1 - np.cumsum(flat[near] * matrix[i], 1)[:, -1]  # term by term, whatever the block
                d, n, g = (np.concatenate(x) for x in zip(kept[i], (exact, names[near], own[near])))
                best = capped(d, n, g, each, k)
                kept[i] = d[best], n[best], g[best]
                if len(best) == k:
                    bound[i] = d[best[-1]]

            for at in range(0, len(ids), step):
                rough = 1 - matrix[at : at + step] @ flat.T
                for i in np.flatnonzero(np.isinf(bound[at : at + step])):  # a bound from the nearest few
                    some = np.argpartition(rough[i], first - 1)[:first] if len(names) > first else np.arange(len(names))
                    before = kept[at + i]
                    take(at + i, some)
                    kept[at + i] = before
                query, row = np.nonzero(rough <= bound[at : at + step, None] + 1e-9)
                ends = np.searchsorted(query, np.arange(len(rough) + 1))
                for i in np.flatnonzero(np.diff(ends)):
                    take(at + i, row[ends[i] : ends[i + 1]])
        groups = list(numbers)
        for i, (d, n, g) in enumerate(kept if numbers else []):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array([groups[x] for x in g], kind), pa.array(d, pa.float64())], names=["query_id", key, group, "distance"])

    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), group, vector).mapInArrow(run, f"query_id long, {key} long, {group} {vectors.schema[group].dataType.simpleString()}, distance double")


def encode(v: Column) -> Column:
    """Little-endian 32-bit floats as bytes."""

    @F.pandas_udf("binary")
    def udf(vectors):
        return vectors.map(lambda x: np.asarray(x, "<f4").tobytes())

    return udf(v)


def decode(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def udf(blobs):
        return blobs.map(lambda x: np.frombuffer(x, "<f4"))

    return udf(blob)


def tier(live: Column) -> Column:
    """Size class of a segment of that many live members."""
    return F.when(live < 5_000, "exact").when(live < 10_000, "5k").when(live < 20_000, "10k").when(live < 40_000, "20k").when(live < 80_000, "40k").when(live < 160_000, "80k").when(live <= 200_000, "capped").otherwise("invalid")


def compaction_plan(segments: DataFrame) -> DataFrame:
    """The next piece of maintenance over (segment, created, live, dead): the oldest segment with over 1 % dead alone, else the two oldest of the smallest class with two. A few rows."""
    from pyspark.sql import Window

    ranks = {"5k": 0, "10k": 1, "20k": 2, "40k": 3, "80k": 4}
    level = F.lit(None).cast("int")
    for name, value in ranks.items():
        level = F.when(F.col("class") == name, value).otherwise(level)
    rows = segments.withColumn("class", tier(F.col("live"))).withColumn("level", level)
    worn = rows.where(F.col("dead") * 100 > F.col("live") + F.col("dead")).orderBy("created").limit(1).select("segment", F.lit(0).alias("step"))
    order = Window.partitionBy("level").orderBy("created")
    pairs = rows.where("level is not null").withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("level")))
    pair = pairs.where("n >= 2 and r <= 2").orderBy("level", "created").limit(2).select("segment", F.lit(1).alias("step"))
    both = worn.unionByName(pair)
    return both.join(F.broadcast(both.agg(F.min("step").alias("step"))), "step").select("segment", F.when(F.col("step") == 0, "clean").otherwise("merge").alias("action"))
