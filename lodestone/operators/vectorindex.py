"""A vector index in Parquet: cells around centres, a partition for each cell.

Centres are fitted on a bounded sample; every valid row is indexed. A search reads the partitions of the cells near its queries,
multiplies blocks of vectors with blocks of queries, keeps only rows that the live table still has unchanged, and adds rows that are
newer than the index by an exact scan of these alone. Cells have radii, so a search can also go on to all cells that might hold
something nearer than what it has found, and is exact then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.vectors import best_rows, nearest, valid
from lodestone.operators.windows import cap_per_group

#: Vectors and queries in one block.
VECTOR_BLOCK, QUERY_BLOCK = 2048, 256


@dataclass(frozen=True)
class Index:
    """Where the cells are, their centres, the least cosine of a member with its centre, and how many cells a search looks at."""

    path: str
    centres: np.ndarray
    least: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equal lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _valid(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, vector, version): rows with a key and a finite vector of the right size and of unit length; others are never found."""
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(valid(F.col(vector), dims), F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector")).withColumn("version", F.xxhash64("vector"))


def fitted(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of unit length by Lloyd's rounds over a bounded sample; the first are spread over it, empty ones stay."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return np.unique(centres, axis=0)


def enough_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """The fewest cells that give this recall of the k nearest, for queries from the sample among its other rows."""
    own = np.argmax(sample @ centres.T, 1)
    picked = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
    near = np.argsort(-(sample[picked] @ sample.T), 1, kind="stable")[:, : k + 1]
    order = np.argsort(np.argsort(-(sample[picked] @ centres.T), 1, kind="stable"), 1)  # rank of each cell for each query
    needed = np.sort(np.take_along_axis(order, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def drawn(rows: DataFrame, total: int, sample: int) -> DataFrame:
    """(vector): the `sample` rows with the least hashes of `total`. Each task would send its own `sample` best to the driver; so rows whose hash is beyond the
    place where twice as many are looked for go first, unless too few are left."""
    of, least = F.xxhash64("key"), rows
    if total > 2 * sample:
        least = rows.where(of <= -(2**63) + 2**65 * sample // total)
        if least.limit(sample).count() < sample:
            least = rows
    return least.orderBy(of, "key").limit(sample).select("vector")


def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, k: int = 10, recall: float = 0.97, sample: int = 8192) -> Index:
    """Write an index of all valid rows to `path` and return it.

    At most `sample` rows (those with the least hashes) are read to the driver for centres and the number of probes; `cells` is the root of
    the number of rows unless given, 4096 at most. Large cells are dealt to several tasks and files. An empty table gives an index of
    one empty cell.
    """
    spark = vectors.sparkSession
    dims = vectors.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = dims[0].n if dims else 1
    rows = _valid(vectors, key, vector, dims)
    total = rows.count()
    held = drawn(rows, total, sample).toPandas()["vector"]
    matrix = np.array(held.tolist(), np.float64).reshape(len(held), dims)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(length > 0, length, 1)
    centres = fitted(matrix, cells or min(4096, max(1, round(total**0.5)))) if len(matrix) else np.zeros((1, dims))
    probes = enough_probes(matrix, centres, k, recall) if len(matrix) else 1

    def assign(batches):
        for b in batches:
            v = _rows(b.column("vector"))
            size = np.linalg.norm(v, axis=1)
            cosine = (v @ centres.T if len(v) else np.zeros((0, len(centres)))) / np.where(size > 0, size, 1)[:, None]
            own = np.argmax(cosine, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(cosine[np.arange(len(own)), own])], names=["key", "vector", "version", "cell", "cosine"])

    placed = rows.mapInArrow(assign, "key long, vector array<float>, version long, cell int, cosine double")
    dealt = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "key")
    packed = dealt.mapInArrow(_packer("key", VECTOR_BLOCK, ["key", "version", "cosine"]), "cell int, key array<long>, version array<long>, cosine array<double>, vectors binary")
    packed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    least = np.full(len(centres), 2.0)  # empty: nothing is nearer
    for r in _read(spark, path).groupBy("cell").agg(F.min(F.array_min("cosine")).alias("least")).collect():  # a row for each cell
        least[r.cell] = r.least
    return Index(path, centres, least, min(probes, len(centres)))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key array<long>, version array<long>, cosine array<double>, vectors binary, cell int").parquet(f"{path}/cells")


def _packer(order: str, block: int, columns: list[str]):
    """Rows (cell, vector, ...) sorted by cell become blocks: the columns as lists, the vectors in one binary value."""

    def run(batches):
        kinds, now, held, vectors = None, None, [], []

        def close() -> pa.RecordBatch:
            lists = [pa.array([list(x)], pa.list_(t)) for x, t in zip(zip(*held), kinds)]
            out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *lists, pa.array([np.concatenate(vectors).astype("<f4").tobytes()], pa.binary())], names=["cell", *columns, "vectors"])
            held.clear()
            vectors.clear()
            return out

        for b in batches:
            kinds = [b.schema.field(c).type for c in columns]
            flat = _rows(b.column("vector"))
            for i, (cell, *row) in enumerate(zip(b.column("cell").to_pylist(), *(b.column(c).to_pylist() for c in columns))):
                if held and (cell != now or len(held) == block):
                    yield close()
                now = cell
                held.append(row)
                vectors.append(flat[i])
        if held:
            yield close()

    return run


def _search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, key, version, distance): the k nearest in the cells that each query asks (query_id, vector, cell). Blocks of vectors meet blocks of queries on their cell; only lists of k leave a pair."""
    spark, dims = asked.sparkSession, index.dims
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # as many as cells at most
    blocks = _read(spark, index.path).where(F.col("cell").isin(cells) if cells else F.lit(False))  # reads these partitions alone
    dealt = asked.hint("rebalance", "cell").sortWithinPartitions("cell", "query_id")
    queries = dealt.mapInArrow(_packer("query_id", QUERY_BLOCK, ["query_id"]), "cell int, query_id array<long>, vectors binary")
    # queries go to many cells: together they are too large to pass through the driver as a broadcast
    pairs = blocks.join(queries.withColumnRenamed("vectors", "asked").hint("merge"), "cell").select("key", "version", "vectors", "query_id", "asked")

    def run(batches):
        for b in batches:
            for keys, versions, raw, ids, wanted in zip(*(b.column(i) for i in range(5))):
                names, vers = np.array(keys.as_py()), np.array(versions.as_py())
                v = np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, dims).astype(np.float64)
                q = np.frombuffer(wanted.as_buffer(), "<f4").reshape(-1, dims).astype(np.float64)
                best = [best_rows(one, v, names, rough, k) for one, rough in zip(q, 1 - q @ v.T)]
                rows, distance = (np.concatenate(x) for x in zip(*best))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.as_py(), [len(x) for x, _ in best])), pa.array(names[rows]), pa.array(vers[rows]), pa.array(distance)], names=["query_id", "key", "version", "distance"])

    return pairs.mapInArrow(run, "query_id long, key long, version long, distance double")


def _cells(index: Index, queries: DataFrame, choose) -> DataFrame:
    """(query_id, vector, cell) for the cells that choose(cosines, rows of the batch) marks."""
    centres = index.centres

    def run(batches):
        for b in batches:
            v = _rows(b.column("vector"))
            if not len(v):
                continue
            size = np.linalg.norm(v, axis=1)
            cosine = v @ centres.T / np.where(size > 0, size, 1)[:, None]
            query, cell = np.nonzero(choose(cosine, b))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(query)), b.column("vector").take(pa.array(query)), pa.array(cell, pa.int32())], names=["query_id", "vector", "cell"])

    return queries.mapInArrow(run, "query_id long, vector array<float>, cell int")


def _near(cosine: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(np.argsort(-cosine, 1, kind="stable"), 1) < probes


def search(index: Index, live: DataFrame, key: str, vector: str, queries: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """(query_id, key, distance): the k nearest live rows of each query (query_id, vector) by 1 - dot, ties by key.

    `live` is the table now: rows of the index that it lacks or has with another vector are left out, and rows that the index lacks are searched
    exactly. Without `exact` the answer has the recall that the index was built for; with it, all cells are read that could still hold
    something nearer than the k-th row found, and nothing is lost. A query without a valid vector has no answer.
    """
    rows, probes, least = _valid(live, key, vector, index.dims), index.probes, index.least
    asked = _valid(queries.withColumnRenamed("query_id", "key"), "key", "vector", index.dims).select(F.col("key").alias("query_id"), "vector")
    blocks = _read(live.sparkSession, index.path).select(F.xxhash64("cell", "key").alias("block"), F.arrays_zip("key", "version").alias("m"))
    blocks = blocks.select("block", F.explode("m").alias("m"))
    held, same = blocks.select("block", "m.key", "m.version"), ["key", "version"]
    fresh, dead = rows.join(held, same, "left_anti"), held.join(rows.select(*same), same, "left_anti")
    # a block's list must have k live rows: it is longer by the most dead rows that a block has
    deep = k + (dead.groupBy("block").count().agg(F.max("count")).first()[0] or 0)
    new = nearest(fresh, asked, "key", "vector", k)
    order = [F.asc("distance"), F.asc("key")]

    def best(cells: DataFrame) -> DataFrame:
        found = _search(index, cells, deep).join(dead.select(*same), same, "left_anti")
        return cap_per_group(found.select("query_id", "key", "distance").unionByName(new), ["query_id"], order, k)

    found = best(_cells(index, asked, lambda cosine, b: _near(cosine, probes)))
    if exact:
        worst = found.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
        reach = asked.join(worst, "query_id", "left").select("query_id", "vector", F.when(F.col("n") >= k, F.col("far")).otherwise(4.0).alias("far"))

        def open_cells(cosine: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            angle = lambda c: np.arccos(np.clip(c, -1, 1))
            bound = np.cos(np.maximum(angle(cosine) - angle(np.minimum(least, 1))[None], 0))  # the greatest cosine of any member
            return (1 - bound <= b.column("far").to_numpy()[:, None] + 3e-3) & (least < 1.5)[None]  # lengths are within a thousandth; 2 marks empty cells

        found = best(_cells(index, reach, open_cells))
    return found.select("query_id", F.col("key").alias(key), "distance")
