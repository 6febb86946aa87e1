"""Ranking and ordering operators: caps, first rows, neighbours, ranges, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], most: int, keep: Column | None = None) -> DataFrame:
    """The best `most` rows of each group; rows that `keep` names stay beyond it."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    wanted = F.col("_rank") <= most
    return ranked.where(wanted | keep if keep is not None else wanted).drop("_rank")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return cap_per_group(df, key, order, 1)


def lane(df: DataFrame, key: str, order: list[Column], depth: int) -> DataFrame:
    """A ranked lane: first row of each key, the best `depth` of those, with `rank` from 1. Only `depth` rows meet in one task."""
    best = first_per_key(df, [key], order).orderBy(*order).limit(depth)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_score(df: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """For each key its highest score (earliest on ties) and where the key was first seen."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(F.col(score), -F.col(seq))).alias("row"), F.min(seq).alias("first_seen")).select(key, "first_seen", "row.*")


def neighbours(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    span = Window.partitionBy(group).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(span)).withColumn("next", F.lead(value).over(span))


def merged_ranges(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching ranges of each group as one (group, start, end, parts)."""
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_new", F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(upto))
    return marked.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_island")


def protected_top(df: DataFrame, order: list[Column], most: int, protected: str) -> DataFrame:
    """The best `most` rows, but protected rows push out the lowest others. Both sorts keep `most` rows only."""
    saved = df.where(protected).orderBy(*order).limit(most)
    others = df.where(f"not ({protected})").orderBy(*order).limit(most)
    rank = Window.orderBy((~F.col("_saved")).cast("int"), *order)
    both = saved.withColumn("_saved", F.lit(True)).unionByName(others.withColumn("_saved", F.lit(False)))
    return both.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= most).drop("_rank", "_saved")


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: str, sizes: dict[str, int], deals: int = 64) -> DataFrame:
    """Of each stratum as many rows as `sizes` says, by a seeded hash: the same rows each time.

    Rows are ranked in `deals` parts of a stratum before they meet in it, so that no task reads more of a large one than the best of each part.
    """
    wanted = {name: size for name, size in sizes.items() if size > 0}
    if not wanted:
        return df.limit(0)
    most = F.lit(0)
    for name, size in wanted.items():
        most = F.when(F.col(stratum) == name, size).otherwise(most)
    rows = df.where(F.col(stratum).isin(*wanted)).withColumn("_by", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).withColumn("_deal", F.pmod(F.xxhash64("_by"), F.lit(deals)))
    order = [F.asc("_by"), F.asc(key)]
    few = cap_per_group(rows, [stratum, "_deal"], order, max(wanted.values()))  # a number, so that tasks cut before they shuffle, too
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank", "_by", "_deal")


def spans(df: DataFrame, group: list[str], at: str, name: str) -> DataFrame:
    """Milliseconds from each event to the next of its group, summed by event name; steps back count for nothing."""
    order = Window.partitionBy(*group).orderBy(at, name)
    step = F.unix_micros(F.lead(at).over(order)) - F.unix_micros(F.col(at))
    return df.withColumn("_step", step).where("_step >= 0").groupBy(name).agg(F.sum(F.floor(F.col("_step") / 1000)).alias("millis"), F.count(F.lit(1)).alias("steps"))
