"""Readiness of a vector profile, retries, and what may be thrown away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backoff(failures: Column, initial: int, most: int) -> Column:
    """Seconds to wait after so many failures in a row: doubling, with a limit."""
    doubled = F.lit(initial) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(40)))
    return F.least(doubled, F.lit(float(most))).cast("long")


def decision(s: Column, exact_cap: int = 25_000, l0_limit: int = 10_000, l0_target: int = 5_000) -> Column:
    """The state of a profile from its counts: ready, blocked, pending, chunks, l0, dead, indexed, corrupt, active; the first rule that holds."""
    complete = s["ready"] + s["blocked"] == s["chunks"]
    worn = lambda percent: s["dead"] * 100 > F.greatest(s["indexed"], F.lit(1)) * percent
    return (
        F.when(s["corrupt"] > 0, "corrupt")
        .when(s["active"] & ((s["l0"] > l0_limit) | worn(2)), "needs_index")
        .when(s["blocked"] * 1000 > s["chunks"], "degraded_blocked")
        .when(complete & ~s["active"] & (s["ready"] > exact_cap), "needs_index")
        .when(complete & s["active"] & ((s["l0"] > l0_target) | worn(1)), "catching_up")
        .when(complete, "ready")
        .otherwise("needs_embeddings")
    )


def expendable(generations: DataFrame, members: DataFrame, grace: Column) -> DataFrame:
    """Segments that no kept generation has: kept are active ones, ones in their grace time, and the last published of each profile."""
    last = generations.where("published > 0").groupBy("profile").agg(F.max_by("generation", "published").alias("generation"))
    kept = generations.where(F.col("active") | grace).select("generation").union(last.select("generation")).distinct()
    reached = members.join(kept, "generation", "left_semi").select("segment")
    return members.select("segment").distinct().join(reached, "segment", "left_anti")
