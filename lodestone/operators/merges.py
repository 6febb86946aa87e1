"""Merge operators for incremental ingest: a snapshot and a batch give the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, batch: DataFrame, key: str, digest: str, keep: list[str] = ()) -> DataFrame:
    """All rows after the batch, with `action`: kept, created, unchanged or updated. Columns in `keep` stay where the batch has them empty."""
    a, b = current.alias("a"), batch.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    old, new = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    action = F.when(~new, "kept").when(~old, "created").when(F.col(f"a.{digest}") == F.col(f"b.{digest}"), "unchanged").otherwise("updated")

    def column(name: str) -> Column:
        mine, theirs = F.col(f"a.{name}"), F.col(f"b.{name}")
        fresh = F.coalesce(F.nullif(theirs, F.lit("")), mine, theirs) if name in keep else theirs
        return F.when(action.isin("created", "updated"), fresh).otherwise(mine).alias(name)

    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(column(c) for c in current.columns if c != key), action.alias("action"))


def apply_versions(entries: DataFrame, batch: DataFrame, key: str, digest: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Current rows (key, digest, version, first_seen, last_seen, action) after a batch (key, digest, at), and the history rows that it adds."""
    a, b = entries.alias("a"), batch.groupBy(key).agg(F.max_by(digest, at).alias(digest), F.max(at).alias(at)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    action = F.when(F.col(f"b.{key}").isNull(), "kept").when(F.col(f"a.{key}").isNull(), "created").when(F.col(f"a.{digest}") == F.col(f"b.{digest}"), "unchanged").otherwise("updated")
    version = F.coalesce("a.version", F.lit(0)) + F.when(action.isin("created", "updated"), 1).otherwise(0)
    after = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.coalesce(f"b.{digest}", f"a.{digest}").alias(digest), version.alias("version"), F.coalesce("a.first_seen", f"b.{at}").alias("first_seen"), F.coalesce(f"b.{at}", "a.last_seen").alias("last_seen"), action.alias("action"))
    return after, after.where(F.col("action").isin("created", "updated")).select(key, digest, "version", F.col("last_seen").alias("observed_at"))


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents left, children left, and the distinct other ends that the deletion touched."""
    doomed = parents.where(gone).select(key)
    return parents.where(~F.coalesce(gone, F.lit(False))), children.join(doomed, key, "left_anti"), children.join(doomed, key, "left_semi")


def dead_letters(queue: DataFrame, attempts: str, most: int) -> DataFrame:
    return queue.withColumn("state", F.when(F.col(attempts) >= most, "dead").otherwise("pending"))


def vocabulary(tags: Column, aliases: dict[str, str], drop: tuple[str, ...] = ()) -> Column:
    """Normal tokens with aliases replaced and dropped ones gone, each once, in order."""
    from lodestone.functions.text import tag_token

    def renamed(tag: Column) -> Column:
        out = tag
        for alias, name in aliases.items():
            out = F.when(tag == alias, name).otherwise(out)
        return out

    normal = F.transform(tags, lambda t: renamed(tag_token(t)))
    return F.array_distinct(F.filter(normal, lambda t: (t != "") & (~t.isin(*drop) if drop else F.lit(True))))


def failure_state(failed: Column, was_failing: Column, count: Column, first_at: Column, now: Column) -> Column:
    """(count, first_at, last_at): goes up while failures go on, starts anew after a success."""
    going_on = was_failing & (count > 0)
    return F.when(failed, F.struct(F.when(going_on, count + 1).otherwise(1).alias("count"), F.when(going_on & (first_at != ""), first_at).otherwise(now).alias("first_at"), now.alias("last_at"))).otherwise(F.struct(F.lit(0).alias("count"), F.lit("").alias("first_at"), F.lit("").alias("last_at")))


def parsed_answer(text: Column, schema: str) -> Column:
    """The JSON object in a model's answer: fences and talk around it go."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
