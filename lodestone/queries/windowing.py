"""Ranks, caps, neighbours, ranges, samples and durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import windows as W
from lodestone.queries import query
from lodestone.sources.tables import table


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3 OR c_custkey % 500 = 0")
def parent_cap(spark, folder):
    """Three best rows for each parent, pinned rows besides."""
    return W.cap_per_group(table(spark, folder, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3, F.col("c_custkey") % 500 == 0).select("c_nationkey", "c_custkey")


@query("""
SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def lane_depth(spark, folder):
    return W.lane(table(spark, folder, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 10).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, max(value) AS value, max_by(event_id, (value, -event_id)) AS event_id, min(event_id) AS first_seen FROM events GROUP BY 1")
def best_score(spark, folder):
    return W.best_score(table(spark, folder, "events").select("user_id", "value", "event_id"), "user_id", "value", "event_id").select("user_id", "value", "event_id", "first_seen")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def neighbours(spark, folder):
    return W.neighbours(table(spark, folder, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "previous", "next")


@query("""
WITH r AS (SELECT l_suppkey, CAST(l_orderkey % 3000 AS BIGINT) AS a, CAST(l_orderkey % 3000 + l_quantity AS BIGINT) AS b FROM lineitem),
m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS parts FROM i GROUP BY l_suppkey, island""")
def merged_ranges(spark, folder):
    start = (F.col("l_orderkey") % 3000).cast("long")
    return W.merged_ranges(table(spark, folder, "lineitem").select("l_suppkey", start.alias("a"), (start + F.col("l_quantity")).cast("long").alias("b")), "l_suppkey", "a", "b")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS versions FROM orders GROUP BY 1")
def latest_version(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("versions"))


@query("""
SELECT user_id, event_id, epoch_us(ts) - epoch_us(before) AS gap FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE epoch_us(ts) - epoch_us(before) > 86400000000""")
def run_gaps(spark, folder):
    """Events more than a day after the one before of the same user."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return table(spark, folder, "events").select("user_id", "event_id", at.alias("at")).withColumn("gap", F.col("at") - before).where("gap > 86400000000").select("user_id", "event_id", "gap")


@query("""
WITH saved AS (SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 60), others AS (SELECT p_partkey, p_retailprice FROM part WHERE p_size <> 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 60)
SELECT p_partkey FROM saved UNION ALL (SELECT p_partkey FROM others ORDER BY p_retailprice DESC, p_partkey LIMIT greatest(60 - (SELECT count(*) FROM saved), 0))""")
def protected_top(spark, folder):
    return W.protected_top(table(spark, folder, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 60, "p_size = 7").select("p_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('2024-W05' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= CASE o_orderstatus WHEN 'F' THEN 50 WHEN 'O' THEN 20 ELSE 0 END")
def stratified_sample(spark, folder):
    return W.stratified_sample(table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", "2024-W05", {"F": 50, "O": 20}).select("o_orderkey", "o_orderstatus")


@query("""
SELECT event_type, CAST(sum((epoch_us(after) - epoch_us(ts)) // 1000) AS BIGINT) AS millis, count(*) AS steps FROM
(SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS after FROM events) WHERE after >= ts GROUP BY 1""")
def trace_durations(spark, folder):
    return W.spans(table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), ["user_id"], "ts", "event_type")


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, lower(n_name), n_nationkey LIMIT 5 OFFSET 5")
def offset_page(spark, folder):
    return table(spark, folder, "nation").orderBy(F.desc("n_regionkey"), F.lower("n_name"), "n_nationkey").offset(5).limit(5).select("n_name", "n_regionkey")
