"""Which posts must be fetched again: flags of an item's media and quotes as one aggregate each, joined once; probes into its JSON; filters of a reset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Failures and hours after which a download is tried again, marks of a quoted post, states that ask for a fetch, endings of still pictures.
MOST_ERRORS, COOLDOWN_HOURS = 3, 24
QUOTE_MARKS = ('"quoted_tweet"', '"quoted_status_result"', '"quoted_post"')
OPEN_STATES = ("", "api_error", "error", "rate_limited")
STILLS = (".jpg", ".jpeg", ".png", ".webp")
STILL_HOST = "https://pbs.twimg.com/"
MOVING = ("video", "animated_gif")
NOTE_URLS = "$.raw.data.tweetResult.result.note_tweet.note_tweet_results.result.entity_set.urls"


def retryable(status: Column, errors: Column, last: Column, now: str) -> Column:
    """Not tried, pending, or failed less often than MOST_ERRORS with the last try (RFC 3339, UTC) COOLDOWN_HOURS before `now` or unknown."""
    due = F.date_format(F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {COOLDOWN_HOURS} HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return status.isin("", "pending") | ((status == "error") & (errors < MOST_ERRORS) & ((last == "") | (last <= due)))


def media_flags(links: DataFrame, assets: DataFrame, now: str) -> DataFrame:
    """(item, retryable, poster): for each item with a link to any asset whether one is to be loaded again, and whether a still picture stands for a moving one.

    `links` has item and asset; `assets` asset, status, errors, last_attempt, kind, path and url. One scan of each; a link to no asset counts as a link.
    """
    path, url = F.col("path"), F.col("url")
    still = reduce(lambda a, b: a | b, (F.endswith(path, F.lit(x)) for x in STILLS)) | F.startswith(F.lower(url), F.lit(STILL_HOST))
    known = assets.select("asset", retryable(F.col("status"), F.col("errors"), F.col("last_attempt"), now).alias("again"), ((F.col("status") == "downloaded") & F.col("kind").isin(*MOVING) & still).alias("still"))
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return links.join(known, "asset", "left").groupBy("item").agg(some("again").alias("retryable"), some("still").alias("poster"))


def quoted(links: DataFrame, kind: str = "quoted_post") -> DataFrame:
    """(item): items with a link of the kind to another item (item, kind)."""
    return links.where(F.col("kind") == kind).select("item").distinct()


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def hydration(items: DataFrame, links: DataFrame, assets: DataFrame, item_links: DataFrame, now: str) -> DataFrame:
    """Items (item, source_type, status, post: JSON, links: JSON array, ...) with media_repair, quote_repair, direct_repair, note_repair and candidate.

    Null texts are empty; JSON that is none has no media and no notes. Items without links are repaired if their post shows media.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flags, has = media_flags(links, assets, now).withColumn("_linked", F.lit(True)), quoted(item_links).withColumn("_quoted", F.lit(True))
    rows = items.join(flags, "item", "left").join(has, "item", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    post, ok = text("post"), valid_json(text("post"))
    media = ok & F.get_json_object(post, "$.snapshot.media_objects[0].type").isNotNull() & (~flag("_linked") | flag("retryable") | flag("poster"))
    marks = reduce(lambda a, b: a | b, (F.contains(F.lower(post), F.lit(m.lower())) for m in QUOTE_MARKS))
    direct = (text("source_type") == "x_quote") & (text("status") == "ok_graphql") & ~F.contains(F.lower(post), F.lit('"tweetresult"'))
    named = F.from_json(F.get_json_object(post, NOTE_URLS), "array<struct<expanded_url:string>>")
    have = F.coalesce(F.from_json(text("links"), "array<string>"), F.array().cast("array<string>"))
    note = ok & F.exists(F.coalesce(named, F.array().cast("array<struct<expanded_url:string>>")), lambda u: (F.coalesce(u["expanded_url"], F.lit("")) != "") & ~F.array_contains(have, u["expanded_url"]))
    note = F.coalesce(note, F.lit(False))
    repairs = {"media_repair": F.coalesce(media, F.lit(False)), "quote_repair": marks & ~flag("_quoted"), "direct_repair": direct, "note_repair": note}
    candidate = text("status").isin(*OPEN_STATES) | (F.startswith(text("status"), F.lit("ok_")) & reduce(lambda a, b: a | b, repairs.values()))
    return rows.select(*(items[c] for c in items.columns), *(c.alias(n) for n, c in repairs.items()), candidate.alias("candidate"))


def reset_filter(domains=(), ids=(), types=(), extract=(), summary=(), kinds=(), least_failures: int = 0) -> Column | None:
    """The sources that a reset names, by all criteria that are given (columns domain, id, source_type, extract_status, summary_status, failure_kind, failures); None without any, so that a reset by mistake takes nothing.

    Values are trimmed and lowered, each once; a domain takes its subdomains along and has no www.; ids must be positive.
    """
    clean = lambda values: list(dict.fromkeys(v for v in (x.strip().lower() for x in values) if v))
    hosts = list(dict.fromkeys(h for h in (d.removeprefix("www.") for d in clean(domains)) if h))
    host, parts = F.lower("domain"), []
    if hosts:
        parts.append(host.isin(*hosts) | reduce(lambda a, b: a | b, (F.endswith(host, F.lit(f".{h}")) for h in hosts)))
    if wanted := list(dict.fromkeys(i for i in ids if i > 0)):
        parts.append(F.col("id").isin(*wanted))
    for column, values in (("source_type", types), ("extract_status", extract), ("summary_status", summary), ("failure_kind", kinds)):
        if wanted := clean(values):
            parts.append(F.col(column).isin(*wanted))
    if least_failures > 0:
        parts.append(F.col("failures") >= least_failures)
    return reduce(lambda a, b: a & b, parts) if parts else None
