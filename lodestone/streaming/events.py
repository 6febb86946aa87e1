"""Structured Streaming forms of the event operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INCIDENT = "user_id long, at timestamp, change string, errors long"


def folder_for(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one on a single machine where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        at = f"file://{tempfile.gettempdir()}/lodestone-streams"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, a few files in each batch."""
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that a single file will do as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(either)


def tumbling(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark go."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, gap: str, *keys: str) -> DataFrame:
    """(keys, start, end, n): runs of events without a longer gap; for streams and tables alike."""
    return events.groupBy(F.session_window(at, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream until its input is used up; what its last batch left (complete), or all it gave (append).

    Each batch has a folder of its own, which it writes anew if it runs again.
    """
    spark = result.sparkSession
    out, state = folder_for(spark, "stream"), folder_for(spark, "checkpoint")

    done: set[int] = set()

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        done.add(n)

    result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], result.schema)
    held = [max(done)] if mode == "complete" else sorted(done)
    return spark.read.schema(result.schema).parquet(*(f"{out}/{n}" for n in held))


def latest_by_key(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The newest row of each key, kept up batch by batch in numbered snapshots; a batch that runs again writes its own snapshot anew."""
    spark = stream.sparkSession
    root, state = folder_for(spark, "latest"), folder_for(spark, "checkpoint")
    columns = [key, *order, *values]
    schema = stream.select(*columns).schema
    done: list[int] = []

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.select(*columns)
        if n > 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{root}/{n - 1}"))
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{root}/{n}")
        done.append(n)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/{max(done)}")


def incidents(stream: DataFrame, remind_hours: float = 24, cooling_hours: float = 6) -> DataFrame:
    """(user_id, at, change, errors): an incident opens at an error, reminds while errors go on, and recovers at a purchase.

    After recovery it cools; an error while cooling opens it again without a new count, later ones begin a new incident.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, since, told, errors = state.get if state.exists else ("none", 0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"]):
            now = ts.timestamp()
            if kind == "error":
                errors = errors + 1 if phase == "open" or phase == "cooling" and now - since <= cooling_hours * 3600 else 1
                if phase != "open":
                    out.append((key[0], ts, "opened", errors))
                    phase, told = "open", now
                elif now - told >= remind_hours * 3600:
                    out.append((key[0], ts, "reminder", errors))
                    told = now
            elif kind == "purchase" and phase == "open":
                out.append((key[0], ts, "recovered", errors))
                phase, since = "cooling", now
        state.update((phase, since, told, errors))
        yield pd.DataFrame(out, columns=["user_id", "at", "change", "errors"])

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id").applyInPandasWithState(step, INCIDENT, "phase string, since double, told double, errors long", "append", GroupStateTimeout.NoTimeout)
