"""Table access. Column pruning and filters reach the Parquet scan; nothing is cached by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.streaming.events import folder_for


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that the cluster shares and read again: computed once."""
    path = folder_for(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """`df` with exactly the columns of a schema: missing strings are empty (absent), others null; extras go."""
    have = set(df.columns)

    def column(field) -> Column:
        if field.name in have:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        return F.lit("" if field.dataType.simpleString() == "string" else None).cast(field.dataType).alias(field.name)

    return df.select(*(column(f) for f in schema.fields))


def lookup(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """Rows that any of the keys names."""
    found = F.lit(False)
    for name, value in keys.items():
        found = found | (F.col(name) == F.lit(value))
    return df.where(found)


def after(columns: list[str], cursor: list) -> Column:
    """Keyset paging: rows after a cursor, by tuple comparison."""
    return F.struct(*(F.col(c) for c in columns)) > F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, cursor)))


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A whole-table Parquet snapshot; Spark's committer makes it appear at once."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str, newest: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; malformed lines go. With `newest`, only the newest `limit` rows, newest first; both are given or neither."""
    if (newest is None) != (limit is None):
        raise ValueError("newest and limit go together")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.col(newest).desc()).limit(limit) if newest else rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): exported text files, a row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
