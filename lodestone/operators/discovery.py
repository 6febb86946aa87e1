"""Link discovery: links of new items become sources and edges, in steps that can be run again.

State is Parquet below one folder: {sources,edges,marks}/version=N hold what step N added, manifests/version=N a row when the step is whole. Readers take versions up to the newest manifest. A step that stops before its manifest leaves nothing that is read, and the
next run writes the same version anew; a step without new items writes nothing. Old rows are never written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normalised_url

SOURCES = "source_key string, url string, kind string, host string, first_item long, first_url string"
EDGES = "item long, source_key string, original_url string, position int"
MARKS = "item long, digest long"
MANIFEST = "items long, links long, sources long, edges long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def version(spark: SparkSession, root: str) -> int:
    """The newest whole step; 0 before the first."""
    if not _exists(spark, f"{root}/manifests"):
        return 0
    found = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{root}/manifests").agg(F.max("version")).first()[0]
    return found or 0


def read(spark: SparkSession, root: str, name: str, upto: int | None = None) -> DataFrame:
    """A table of the state (sources, edges or marks) with the version that added each row."""
    schema = {"sources": SOURCES, "edges": EDGES, "marks": MARKS}[name]
    upto = version(spark, root) if upto is None else upto
    if not upto:
        return spark.createDataFrame([], f"{schema}, version int")
    return spark.read.schema(f"{schema}, version int").parquet(f"{root}/{name}").where(F.col("version") <= upto)


def _unknown(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key `old` lacks. `old` meets the few new keys first, so that it need not be shuffled where they are small."""
    seen = old.join(new.select(*key).distinct(), key, "left_semi").select(*key)
    return new.join(seen, key, "left_anti")


def discover(items: DataFrame, item: str, links: str, root: str, force: bool = False, upto_items: int | None = None) -> DataFrame:
    """One step over items (item, links: array of raw addresses) that are new or whose links have changed; one row of what it did.

    Links that are no pages go; a source is its normalised address, the first item (and the first link in it) that named it gives its first address.
    An edge is an item and a source, with the first of the item's links that led there; existing sources and edges stay as they are. `force` takes all
    items again, `upto_items` the first so many by id. Null items go; null links are none. Items with equal ids are one, their links together.
    """
    spark = items.sparkSession
    now = version(spark, root)
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.coalesce(links, F.array().cast("array<string>")).alias("links"), F.xxhash64(links).alias("digest"))
    todo = rows if force else _unknown(rows, read(spark, root, "marks", now), ["item", "digest"])
    if upto_items is not None:
        todo = todo.orderBy("item", "digest").limit(upto_items)
    at = f"{root}/step/version={now + 1}"
    found = todo.select("item", "digest", F.posexplode_outer("links").alias("position", "raw")).withColumn("u", normalised_url(F.col("raw")))
    found.select("item", "digest", "position", "raw", F.col("u.url").alias("url"), F.col("u.kind").alias("kind"), F.col("u.host").alias("host"), F.col("u.key").alias("source_key")).write.mode("overwrite").parquet(at)
    step = spark.read.parquet(at)
    links_ = step.where("source_key is not null")
    size = step.agg(F.count_distinct("item", "digest").alias("items")).first().items
    if not size:
        return spark.createDataFrame([(0, 0, 0, 0)], MANIFEST)
    edges = links_.groupBy("item", "source_key").agg(F.min_by(F.struct("raw", "position"), F.struct("position", "raw")).alias("f")).select("item", "source_key", F.col("f.raw").alias("original_url"), "f.position")
    first = F.min_by(F.struct("url", "kind", "host", F.col("item").alias("first_item"), F.col("raw").alias("first_url")), F.struct("item", "position", "raw"))
    sources = links_.groupBy("source_key").agg(first.alias("f")).select("source_key", "f.*")
    marks = step.select("item", "digest").distinct()
    fresh = {"sources": (sources, ["source_key"]), "edges": (edges, ["item", "source_key"]), "marks": (marks, ["item", "digest"])}
    for name, (table, key) in fresh.items():
        _unknown(table, read(spark, root, name, now), key).write.mode("overwrite").parquet(f"{root}/{name}/version={now + 1}")
    added = {name: spark.read.parquet(f"{root}/{name}/version={now + 1}").count() for name in ("sources", "edges")}
    done = spark.createDataFrame([(size, edges.count(), added["sources"], added["edges"])], MANIFEST)
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/version={now + 1}")
    return done
