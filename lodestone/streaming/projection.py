"""Incremental projection: parents whose revision was raised are cut into chunks anew, up to a watermark.

A stream reads a log of changes (parent, revision, text). Each step takes the changes up to a logical watermark, keeps the newest of each parent,
and writes its chunks; changes beyond the watermark are carried to the next step and stay dirty. State is Parquet below one folder:
{chunks,done,later}/step=S and, written last, steps/step=S. A step writes only what it has read itself beyond the watermark; what waits is
read from all steps, without what a watermark has reached since. Readers take whole steps alone; a step that runs again writes its folders
anew. Which changes are due is found without their texts. The stream's own checkpoint, in the same folder, is the durable boundary from which the next run goes on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Cut = Callable[[DataFrame], DataFrame]
#: Keys with their revision up to which they are broadcast to the changes.
KNOWN = 1_000_000


def steps(spark: SparkSession, root: str) -> list[str]:
    """Names of whole steps in order; a name for each batch of changes and each raise of the watermark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/steps")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return sorted(r.step for r in spark.read.schema("upto long, step string").parquet(f"{root}/steps").select("step").distinct().collect())


def _read(spark: SparkSession, root: str, name: str, schema: StructType, whole: list[str]) -> DataFrame:
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{name}/step={s}" for s in whole))


def _newest(rows: DataFrame, parent: str, revision: str) -> DataFrame:
    """The row of the highest revision of each parent; of equal ones the greatest."""
    return rows.groupBy(parent).agg(F.max(F.struct(revision, *(c for c in rows.columns if c not in (parent, revision)))).alias("r")).select(parent, "r.*").select(*rows.columns)


class Projection:
    """`cut` gives the chunks of rows (parent, revision, text): the same first two columns and any others."""

    def __init__(self, spark: SparkSession, root: str, changes: StructType, cut: Cut, parent: str = "parent", revision: str = "revision"):
        self.spark, self.root, self.changes, self.cut, self.parent, self.revision = spark, root, changes, cut, parent, revision
        self.chunk_schema = cut(spark.createDataFrame([], changes)).schema
        self.done_schema = spark.createDataFrame([], changes).select(parent, revision).schema

    def _done(self, spark: SparkSession, whole: list[str]) -> DataFrame:
        """(parent, revision) that is projected."""
        return _read(spark, self.root, "done", self.done_schema, whole).groupBy(self.parent).agg(F.max(self.revision).alias(self.revision))

    def _later(self, spark: SparkSession, whole: list[str]) -> DataFrame:
        """Changes that wait: of each step those beyond the watermarks of this and all later steps."""
        if not whole:
            return spark.createDataFrame([], self.changes)
        upto = {r.step: r.upto for r in spark.read.schema("upto long, step string").parquet(f"{self.root}/steps").collect()}  # a row for each step
        groups, reach = {}, None
        for s in reversed(whole):
            reach = upto[s] if reach is None else max(reach, upto[s])
            groups.setdefault(reach, []).append(s)
        parts = [_read(spark, self.root, "later", self.changes, held).where(F.col(self.revision) > reach) for reach, held in groups.items()]
        return functools.reduce(DataFrame.union, parts)

    def _due(self, rows: DataFrame, before: list[str], name: str) -> DataFrame:
        """The newest of each parent's rows, if it is newer than what is projected. Keys are counted first; texts are shuffled only for keys too many to broadcast, and where a revision came more than once."""
        spark, root, key, revision = rows.sparkSession, self.root, self.parent, self.revision
        counted = rows.groupBy(key, revision).agg(F.count(F.lit(1)).alias("n"))
        newest = counted.groupBy(key).agg(F.max(F.struct(revision, "n")).alias("r")).select(key, "r.*")
        have = self._done(spark, before).select(F.col(key).alias("_key"), F.col(revision).alias("_have"))
        due = newest.join(have, F.col(key) == F.col("_key"), "left").where(F.col("_have").isNull() | (F.col("_have") < F.col(revision)))
        due.select(key, revision, "n").write.mode("overwrite").parquet(f"{root}/due/step={name}")
        due = spark.read.schema(due.select(key, revision, "n").schema).parquet(f"{root}/due/step={name}")
        found = lambda which: (F.broadcast(which) if which.count() <= KNOWN else which).select(key, revision)  # noqa: E731  two numbers a row
        once = rows.join(found(due.where("n = 1")), [key, revision], "left_semi")
        more = rows.join(found(due.where("n > 1")), [key, revision], "left_semi")
        return once.select(*self.changes.names).unionByName(_newest(more.select(*self.changes.names), key, revision))

    def step(self, changes: DataFrame | None, name: str, upto: int) -> None:
        """One step: changes and what waits, up to the watermark; then the step is whole."""
        spark = self.spark if changes is None else changes.sparkSession
        root, key, revision = self.root, self.parent, self.revision
        before = [s for s in steps(spark, root) if s < name]
        rows = self._later(spark, before)
        new = spark.createDataFrame([], self.changes)
        if changes is not None:
            new = changes.select(*self.changes.names).where(F.col(key).isNotNull() & F.col(revision).isNotNull())
            rows = rows.unionByName(new)
        due = self._due(rows.where(F.col(revision) <= upto), before, name)
        self.cut(due).write.mode("overwrite").parquet(f"{root}/chunks/step={name}")
        spark.read.schema(self.done_schema).parquet(f"{root}/due/step={name}").write.mode("overwrite").parquet(f"{root}/done/step={name}")
        new.where(F.col(revision) > upto).write.mode("overwrite").parquet(f"{root}/later/step={name}")
        spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{root}/steps/step={name}")

    def run(self, stream: DataFrame, upto: int) -> None:
        """Take all changes that are there, in batches; then what earlier runs carried and this watermark reaches."""
        spark, root = self.spark, self.root
        self._raise(upto)
        query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        query.foreachBatch(lambda batch, n: self.step(batch, f"{n:012d}", upto)).start().awaitTermination()

    def _raise(self, upto: int) -> None:
        """A step without changes, if the watermark was raised and something carried lies below it."""
        whole = steps(self.spark, self.root)
        if whole and self._later(self.spark, whole).where(F.col(self.revision) <= upto).limit(1).count():
            self.step(None, f"{whole[-1]}+", upto)

    def chunks(self, *more: Column) -> DataFrame:
        """The chunks of each parent's projected revision: all columns or, instead of the texts, what `more` takes from each chunk before they meet their revision."""
        whole = steps(self.spark, self.root)
        found = _read(self.spark, self.root, "chunks", self.chunk_schema, whole)
        found = found.select(self.parent, self.revision, *more) if more else found
        return found.join(self._done(self.spark, whole), [self.parent, self.revision], "left_semi")

    def projected(self) -> DataFrame:
        """(parent, revision): what the chunks are of; a parent without text has a revision and no chunks."""
        return self._done(self.spark, steps(self.spark, self.root))

    def dirty(self) -> DataFrame:
        """(parent, revision): the newest change of each parent that waits for a higher watermark."""
        whole = steps(self.spark, self.root)
        later = self._later(self.spark, whole)
        return later.groupBy(self.parent).agg(F.max(self.revision).alias(self.revision))
