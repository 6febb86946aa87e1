"""The event log, its pages, and activity over time."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event of a kind asks for.
BACKGROUND = ("source_created", "source_extracted")
FAILURE = ("source_failed", "item_enrichment_failed")
#: Sources that a person chose by hand.
HIGH_INTENT = ("apple_note", "safari_tab", "x_bookmark", "mastodon_bookmark", "mastodon_quote", "mastodon_reblog", "github_star", "feed_entry")
MEDIA_KINDS = ("x_media_transcribed", "x_photo_ocred")


def actionability(kind: Column) -> Column:
    return F.when(kind.isin(*BACKGROUND), "background").when(kind == "blocked", "blocked").when(kind.isin(*FAILURE), "failure").otherwise("review")


def importance(kind: Column, summary: Column, tags: Column, source_type: Column) -> Column:
    """40; 50 more for failures, 25 or 30 for a summary, 20 for tags, 10 for a chosen source, 10 less for a new source; 0 to 100."""
    score = F.lit(40) + F.when(actionability(kind).isin("failure", "blocked"), 50).otherwise(0)
    score = score + F.when(F.trim(summary) != "", F.when(kind.isin(*MEDIA_KINDS), 25).otherwise(30)).otherwise(0)
    score = score + F.when(F.size(tags) > 0, 20).otherwise(0) + F.when(source_type.isin(*HIGH_INTENT), 10).otherwise(0) - F.when(kind == "source_created", 10).otherwise(0)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def event_log(branches: list[DataFrame]) -> DataFrame:
    """The union of event branches with the same columns; each branch keeps its own filter and column pruning."""
    log = branches[0]
    for branch in branches[1:]:
        log = log.unionByName(branch)
    return log


def page(log: DataFrame, keys: list[str], cursor: list | None, size: int) -> DataFrame:
    """The rows after a cursor, by a total order of keys."""
    rows = log
    if cursor is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, cursor))))
    return rows.orderBy(*keys).limit(size)


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> list:
    return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))


def since(text: str, now: datetime) -> datetime:
    """An RFC 3339 time, or so many days (7d) or hours (12h) before now."""
    if m := re.fullmatch(r"(\d+)([dh])", text.strip()):
        return now - timedelta(days=int(m[1])) if m[2] == "d" else now - timedelta(hours=int(m[1]))
    return datetime.fromisoformat(text.strip().replace("Z", "+00:00"))


def bucket_hours(window_hours: float) -> int:
    for most, width in ((12, 1), (24, 2), (72, 6), (168, 12)):
        if window_hours <= most:
            return width
    return 24


def trend(log: DataFrame, at: str, good: Column, end: datetime, window_hours: int) -> DataFrame:
    """(start, good, bad) for each bucket up to the one that holds `end`; empty buckets count zero.

    Counts combine before the shuffle; the spine has as many rows as the window has buckets.
    """
    spark, width = log.sparkSession, bucket_hours(window_hours) * 3600
    last = int(end.timestamp()) // width * width
    first = last - (-(-window_hours * 3600 // width) - 1) * width
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    start = (F.floor(second / width) * width).cast("long")
    counts = log.where((second >= first) & (second < last + width)).groupBy(start.alias("start")).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    spine = spark.range(first, last + 1, width).withColumnRenamed("id", "start")
    return spine.join(counts, "start", "left").fillna(0, ["good", "bad"])
