"""Counting and status operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def oldest_instant(text: Column) -> Column:
    """Aggregate: the earliest of RFC 3339 texts; null if any of them cannot be read."""
    at = F.try_to_timestamp(text)
    return F.when(F.count_if(at.isNull()) > 0, F.lit(None)).otherwise(F.min(at))


def partition(df: DataFrame, kind: str, states: dict[str, Column]) -> DataFrame:
    """For each kind, and for `all`: total, the count of each state, the rest as unknown, whether states fit, and the percentage of the first state."""
    counts = [F.count_if(c).alias(name) for name, c in states.items()]
    rolled = df.rollup(kind).agg(F.count(F.lit(1)).alias("total"), *counts, F.grouping_id().alias("_g"))
    known = sum((F.col(name) for name in states), F.lit(0))
    first = next(iter(states))
    return rolled.select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col(kind)).alias(kind),
        "total",
        *states,
        F.greatest(F.col("total") - known, F.lit(0)).alias("unknown"),
        (known <= F.col("total")).alias("partition_valid"),
        F.when(F.col("total") == 0, 0.0).otherwise(F.round(100 * F.col(first) / F.col("total"), 4)).alias("percent"),
    )


def hotspots(df: DataFrame, keys: list[str], at: str, least: int = 2) -> DataFrame:
    """Groups that occur `least` times or more, with their latest time."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("latest")).where(F.col("n") >= least)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of each column, in one pass; rows fan out to a value for each column before the map-side count."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def first_seen_counts(df: DataFrame, kind: str, seq: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))


def entity_view(events: DataFrame) -> DataFrame:
    """For each entity_key the digest of its events (at, seq, kind, title, status, importance, action_rank, summary)."""
    first_text = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("seq")))
    ordered = F.array_sort(F.collect_set(F.struct("kind")))
    return events.groupBy("entity_key").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("at").alias("first_at"),
        F.max("at").alias("latest_at"),
        F.coalesce(first_text("title"), F.lit("")).alias("title"),
        F.max_by("status", F.struct("at", "seq")).alias("status"),
        F.transform(ordered, lambda x: x["kind"]).alias("kinds"),
        F.max("importance").alias("importance"),
        F.max("action_rank").alias("action_rank"),
    )


def with_provenance(df: DataFrame, value: str, fields: list[str], at: str, cutover: str) -> DataFrame:
    """One row: derived values, complete ones, for each field how many lack it, split at a cut-over time (unreadable times are after it)."""
    made = F.col(value) != ""
    lacks = [made & (F.coalesce(F.col(f), F.lit("")) == "") for f in fields]
    after = F.coalesce(F.try_to_timestamp(F.col(at)) >= F.to_timestamp(F.lit(cutover)), F.lit(True))
    any_lack = lacks[0]
    for c in lacks[1:]:
        any_lack = any_lack | c
    return df.agg(F.count_if(made).alias("made"), F.count_if(made & ~any_lack).alias("complete"), *(F.count_if(c).alias(f"missing_{f}") for f, c in zip(fields, lacks)), F.count_if(any_lack & ~after).alias("missing_before"), F.count_if(any_lack & after).alias("missing_after"))


def exact_recall(truth: Column, found: Column) -> Column:
    return F.size(F.array_intersect(truth, found)) / F.size(truth)
