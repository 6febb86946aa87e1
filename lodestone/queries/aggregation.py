"""Counts, status partitions, facets, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregates as A
from lodestone.queries import query
from lodestone.sources.tables import table


@query("SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1, 2")
def grouped_count(spark, folder):
    return A.count_by(table(spark, folder, "documents").where("n_chars > 500"), "source", "lang")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 15 MINUTE) AS recent FROM events GROUP BY 1")
def activity_snapshot(spark, folder):
    """Latest time as text, and counts in a look-back window from a given now."""
    recent = F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz") - F.expr("INTERVAL 15 MINUTES")
    return table(spark, folder, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest"), F.count_if(recent).alias("recent"))


@query("""
SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderkey % 1000 = 0) > 0 THEN NULL ELSE strftime(min(o_orderdate), '%Y-%m-%d') END AS oldest FROM orders GROUP BY 1""")
def oldest_or_unknown(spark, folder):
    """The earliest time of each group, unknown if any of its times cannot be read."""
    text = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 1000 == 0), "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, folder, "orders").withColumn("at", text).groupBy("o_orderpriority").agg(F.date_format(A.oldest_instant(F.col("at")), "yyyy-MM-dd").alias("oldest"))


@query("""
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS current,
  count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS pending, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS blocked,
  count(*) - count(*) FILTER (WHERE o_orderstatus = 'F') - count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) - count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS unknown,
  true AS partition_valid, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS percent
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def pipeline_partition(spark, folder):
    """Totals by state for each kind and for all, in one rollup."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return A.partition(table(spark, folder, "orders"), "o_orderpriority", {"current": status == "F", "pending": (status == "O") & (key % 2 == 0), "blocked": (status == "P") & (key % 3 == 0)})


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS backlog, count(*) FILTER (WHERE o_orderstatus = 'P') AS retry, count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AS drained, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS next FROM orders""")
def backlog(spark, folder):
    opened = F.col("o_orderstatus") == "O"
    return table(spark, folder, "orders").agg(F.count_if(opened).alias("backlog"), F.count_if(F.col("o_orderstatus") == "P").alias("retry"), (F.count_if(opened) == 0).alias("drained"), F.min(F.when(opened, F.col("o_orderkey"))).alias("next"))


@query("""
SELECT user_id, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2 HAVING count(*) >= 2
ORDER BY n DESC, latest DESC, user_id, event_type LIMIT 40""")
def failure_hotspots(spark, folder):
    found = A.hotspots(table(spark, folder, "events").where(F.col("event_type").isin("error", "purchase")), ["user_id", "event_type"], "ts")
    return found.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss")).orderBy(F.desc("n"), F.desc("latest"), "user_id", "event_type").limit(40).select("user_id", "event_type", "n", "latest")


@query("""
SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2""")
def failure_facets(spark, folder):
    return A.facets(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def counts_first_seen(spark, folder):
    return A.first_seen_counts(table(spark, folder, "events"), "event_type", "event_id")


@query("""
SELECT user_id AS entity_key, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_at,
  coalesce(min_by(event_type || '!', event_id) FILTER (WHERE event_id % 3 = 0), '') AS title, max_by(event_type, (ts, event_id)) AS status,
  array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, max(CASE event_type WHEN 'error' THEN 90 ELSE 40 END) AS importance, max(event_id % 4) AS action_rank
FROM events GROUP BY 1""")
def entity_view(spark, folder):
    """All that happened to an entity in one row, by aggregates that combine before the shuffle."""
    kind = F.col("event_type")
    events = table(spark, folder, "events").select(F.col("user_id").alias("entity_key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, F.concat(kind, F.lit("!"))).otherwise("").alias("title"), kind.alias("status"), F.when(kind == "error", 90).otherwise(40).alias("importance"), (F.col("event_id") % 4).alias("action_rank"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return A.entity_view(events).withColumns({c: at(c) for c in ("first_at", "latest_at")}).withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END, ''), 'unknown') AS bucket, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, lower(bucket) LIMIT 10")
def coverage_buckets(spark, folder):
    kind = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type"))
    return A.count_by(table(spark, folder, "part").select(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("bucket")), "bucket").orderBy(F.desc("n"), F.lower("bucket")).limit(10)


@query("""
SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS token FROM part) GROUP BY 1 HAVING count(*) >= 2""")
def tag_histogram(spark, folder):
    """Tokens of all rows with at least two uses."""
    words = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), "[^a-z0-9]+", " "), " ")
    tokens = F.array_distinct(F.filter(words, lambda x: x != ""))
    return A.count_by(table(spark, folder, "part").select(F.explode(tokens).alias("token")), "token").where("n >= 2")


@query("""
WITH t AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT a.w AS alias, b.w AS canonical FROM t a JOIN t b ON a.w <> b.w AND a.n <= b.n AND length(a.w) >= 4 AND length(b.w) >= 4 AND levenshtein(a.w, b.w) <= 2""")
def alias_pairs(spark, folder):
    """Rare tokens within two edits of one at least as frequent: both leave a common string when up to two letters are taken out."""
    counts = A.count_by(table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("w")), "w").where("length(w) >= 4")
    a = counts.select(F.col("w").alias("alias"), F.col("n").alias("na"), F.explode(T.deletions(F.col("w"))).alias("d"))
    b = counts.select(F.col("w").alias("canonical"), F.col("n").alias("nb"), F.explode(T.deletions(F.col("w"))).alias("d"))
    pairs = a.join(b, "d").where("alias <> canonical and na <= nb").select("alias", "canonical").distinct()
    return pairs.where(F.levenshtein("alias", "canonical", 2) >= 0)


@query("SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_proof(spark, folder):
    return A.count_by(table(spark, folder, "documents").select(F.md5("text").alias("text_hash")), "text_hash").where("n > 1")


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT md5(text)) AS texts, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def distinct_and_sums(spark, folder):
    return table(spark, folder, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.md5("text")).alias("texts"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""
SELECT count(*) FILTER (WHERE made) AS made, count(*) FILTER (WHERE made AND m <> '' AND t <> '') AS complete, count(*) FILTER (WHERE made AND m = '') AS missing_model, count(*) FILTER (WHERE made AND t = '') AS missing_tool,
  count(*) FILTER (WHERE made AND (m = '' OR t = '') AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey % 11 <> 0) AS missing_before, count(*) FILTER (WHERE made AND (m = '' OR t = '') AND (o_orderdate >= TIMESTAMP '1996-01-01' OR o_orderkey % 11 = 0)) AS missing_after
FROM (SELECT *, o_orderstatus <> 'O' AS made, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'm' END AS m, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 't' END AS t FROM orders)""")
def provenance(spark, folder):
    blank = lambda n, v: F.when(F.col("o_orderkey") % n == 0, "").otherwise(v)
    rows = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") != "O", "x").otherwise("").alias("value"), blank(4, "m").alias("model"), blank(6, "t").alias("tool"), F.when(F.col("o_orderkey") % 11 == 0, "then").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"))
    return A.with_provenance(rows, "value", ["model", "tool"], "at", "1996-01-01")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, folder):
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 4)
    return table(spark, folder, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE length(text) > 200) AS ok, count(*) FILTER (WHERE length(text) <= 200) AS errors, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_chars FROM conversations GROUP BY 1")
def model_summary(spark, folder):
    """Runs by model: good, bad, and an average by whole division."""
    size = F.length("text")
    return table(spark, folder, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(size > 200).alias("ok"), F.count_if(size <= 200).alias("errors"), F.expr("sum(length(text)) div count(1)").alias("avg_chars"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_orderkey % 4999 = 0")
def foreign_key_audit(spark, folder):
    """Rows whose parent is missing (or that a rule names)."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lost = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")
    return lost.union(orders.where("o_orderkey % 4999 = 0").select("o_orderkey")).distinct()


@query("""
SELECT page_id, CASE WHEN length(trim(t)) < 40 THEN 'short' WHEN regexp_matches(lower(t), 'enable javascript|access denied') THEN 'shell' WHEN regexp_matches(lower(t), 'subscribe to (read|continue)') THEN 'paywall' ELSE 'ok' END AS verdict
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'Please enable JavaScript to view this page properly, thank you' WHEN 2 THEN 'Subscribe to continue reading this story and many others today' ELSE html END AS t FROM pages)""")
def extract_rejection(spark, folder):
    t = F.when(F.col("page_id") % 4 == 0, "x").when(F.col("page_id") % 4 == 1, "Please enable JavaScript to view this page properly, thank you").when(F.col("page_id") % 4 == 2, "Subscribe to continue reading this story and many others today").otherwise(F.col("html"))
    low = F.lower(t)
    verdict = F.when(F.length(F.trim(t)) < 40, "short").when(low.rlike("enable javascript|access denied"), "shell").when(low.rlike("subscribe to (read|continue)"), "paywall").otherwise("ok")
    return table(spark, folder, "pages").select("page_id", verdict.alias("verdict"))


@query("""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(lower(l), 'licensed under')), chr(10)) AS clean FROM documents""")
def noise_lines(spark, folder):
    lines = F.transform(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"), lambda line: F.trim(line))
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.filter(lines, lambda line: (line != "") & ~F.startswith(F.lower(line), F.lit("licensed under"))), "\n").alias("clean"))


@query("SELECT token, count(*) AS n FROM (SELECT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS token FROM orders) GROUP BY 1")
def normal_tokens(spark, folder):
    return A.count_by(table(spark, folder, "orders").select(T.tag_token(F.col("o_orderpriority")).alias("token")), "token")
