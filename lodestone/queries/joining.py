"""Joins of every kind that the corpus queries use."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph
from lodestone.queries import query
from lodestone.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def edge_traversal(spark, folder):
    return table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("SELECT p_partkey, count(DISTINCT l_orderkey) AS backlinks FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def backlinks(spark, folder):
    found = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("backlinks"))
    return table(spark, folder, "part").join(found, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


@query("""
SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_shipmode END), '') AS a FROM orders LEFT JOIN (SELECT *, 'm' || l_linenumber AS l_shipmode FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1""")
def role_value(spark, folder):
    """The value of a role if a row for the role exists, else a fallback: one aggregation in place of a subquery for each role."""
    roles = table(spark, folder, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.max(F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).alias("a"))
    return table(spark, folder, "orders").join(roles, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("a", F.lit("")).alias("a"))


@query("""
SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS role_a, count(*) FILTER (WHERE l_returnflag = 'N') AS role_n, count(*) FILTER (WHERE l_returnflag = 'R') AS role_r
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def role_pivot(spark, folder):
    """Roles as columns; the pivot's values are given, so that no extra pass finds them."""
    flags = table(spark, folder, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(f"role_{c.lower()}")
    return table(spark, folder, "orders").select("o_orderkey").join(flags, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", zero("A"), zero("N"), zero("R"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND s_nationkey < 12) ORDER BY o_orderkey LIMIT 500""")
def unflushed_page(spark, folder):
    """The next page of rows that no member of a set covers."""
    members = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").where("s_nationkey < 12"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey")
    return table(spark, folder, "orders").join(members, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").orderBy("o_orderkey").limit(500).select("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_type = 'PROMO')")
def existence(spark, folder):
    promo = table(spark, folder, "lineitem").join(table(spark, folder, "part").where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey")
    return table(spark, folder, "supplier").join(promo, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT position, c_custkey, c_mktsegment FROM (VALUES (1, 9), (2, 3), (3, 100000000), (4, 44)) v(position, key) JOIN customer ON c_custkey = key")
def keyed_in_order(spark, folder):
    """Rows of a given list of keys, with their places in it; the list is the caller's and goes to all tasks."""
    wanted = spark.createDataFrame([(1, 9), (2, 3), (3, 100000000), (4, 44)], "position int, key long")
    return table(spark, folder, "customer").join(F.broadcast(wanted), F.col("c_custkey") == F.col("key")).select("position", "c_custkey", "c_mktsegment")


@query("""
SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0 OR (l.toxic = 1 AND d.doc_id % 2 = 0)""")
def due_rows(spark, folder):
    """Rows without a result, with a stale one, or with a failed one that is due."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("there"))
    due = F.col("there").isNull() | (F.col("quality") == 0) | ((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0))
    return table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left").where(due).select("doc_id")


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN c_name END, CASE WHEN event_id % 2 = 1 THEN s_name END) AS parent
FROM events LEFT JOIN customer ON event_id % 2 = 0 AND c_custkey = user_id LEFT JOIN supplier ON event_id % 2 = 1 AND s_suppkey = user_id""")
def polymorphic_parent(spark, folder):
    """The parent is in one of two tables, by kind."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    even = F.col("event_id") % 2 == 0
    joined = events.join(table(spark, folder, "customer"), even & (F.col("c_custkey") == F.col("user_id")), "left").join(table(spark, folder, "supplier"), ~even & (F.col("s_suppkey") == F.col("user_id")), "left")
    return joined.select("event_id", F.coalesce("c_name", "s_name").alias("parent"))


@query("SELECT event_type, round(100.0 * count(*) / max(total), 4) AS share FROM events, (SELECT count(*) AS total FROM events) GROUP BY 1")
def with_singleton(spark, folder):
    """Rows beside a single row of state; one row is broadcast."""
    events = table(spark, folder, "events")
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("event_type", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query("""
WITH t AS (SELECT DISTINCT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) >= 4),
e AS (SELECT s_suppkey, unnest(['red', 'ring', 'widget', 'blue'][1 + s_suppkey % 4 : 1 + s_suppkey % 4]) AS w FROM supplier),
k AS (SELECT p_partkey, array_to_string(list_sort(list(w)), ',') AS k FROM t GROUP BY 1)
SELECT p_partkey, first AS class_id, coalesce(links, 0) AS links FROM k JOIN (SELECT k, min(p_partkey) AS first FROM k GROUP BY 1) USING (k)
LEFT JOIN (SELECT p_partkey, count(DISTINCT s_suppkey) AS links FROM t JOIN e USING (w) GROUP BY 1) USING (p_partkey)""")
def token_join(spark, folder):
    """Rows that share a token of four characters or more, as classes of equal tokens with the number of their links."""
    words = F.explode(F.split("p_name", " ")).alias("w")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("left_key"), words).where("length(w) >= 4")
    given = F.element_at(F.array(*map(F.lit, ("red", "ring", "widget", "blue"))), (1 + F.col("s_suppkey") % 4).cast("int"))
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("right_key"), given.alias("w")).where("length(w) >= 4")
    return graph.linked_classes(parts, names, "w").select(F.col("left_key").alias("p_partkey"), "class_id", "links")


@query("SELECT n_name, count(*) AS docs FROM nation JOIN documents ON contains(lower(text), lower(substr(n_name, 1, 3))) GROUP BY 1")
def contains_join(spark, folder):
    """A bounded list of terms (25 nations) against all texts, one pass over the texts."""
    nations = table(spark, folder, "nation").select("n_name", F.lower(F.substring("n_name", 1, 3)).alias("term"))
    docs = table(spark, folder, "documents").select(F.lower("text").alias("low"))
    return docs.join(F.broadcast(nations), F.contains("low", "term")).groupBy("n_name").agg(F.count(F.lit(1)).alias("docs"))


@query("""
WITH e AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id ELSE -1 END AS guid, CASE WHEN page_id % 5 = 0 THEN page_id + 1 ELSE -1 END AS ident, page_id + 2 AS link FROM pages)
SELECT page_id, coalesce(g.doc_id, i.doc_id, l.doc_id) AS matched, coalesce(g.doc_id <> l.doc_id, false) AS conflict
FROM e LEFT JOIN documents g ON g.doc_id = guid LEFT JOIN documents i ON i.doc_id = ident LEFT JOIN documents l ON l.doc_id = link""")
def priority_match(spark, folder):
    """A row that guid, identity or link may match, in that order, and whether the first and the last disagree."""
    when = lambda n, add: F.when(F.col("page_id") % n == 0, F.col("page_id") + add).otherwise(-1)
    entries = table(spark, folder, "pages").select("page_id", when(3, 0).alias("guid"), when(5, 1).alias("ident"), (F.col("page_id") + 2).alias("link"))
    for key in ("guid", "ident", "link"):
        entries = entries.join(table(spark, folder, "documents").select(F.col("doc_id").alias(f"by_{key}")), F.col(key) == F.col(f"by_{key}"), "left")
    return entries.select("page_id", F.coalesce("by_guid", "by_ident", "by_link").alias("matched"), F.coalesce(F.col("by_guid") != F.col("by_link"), F.lit(False)).alias("conflict"))


@query("SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
def join_using(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id").select("doc_id", "quality", "n_chars")


@query("""
SELECT a.conv_id, round(list_count(list_intersect(wa, wb)) / CAST(len(wa) AS DOUBLE), 6) AS overlap FROM
(SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS wa FROM conversations WHERE turn = 1) a JOIN
(SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS wb FROM conversations WHERE turn = 2) b USING (conv_id) WHERE len(wa) > 0""")
def baseline_overlap(spark, folder):
    """Share of one turn's words that the next has."""
    turns = table(spark, folder, "conversations")
    side = lambda n, name: turns.where(F.col("turn") == n).select("conv_id", T.word_set(F.col("text")).alias(name))
    return side(1, "wa").where(F.size("wa") > 0).join(side(2, "wb"), "conv_id").select("conv_id", F.round(T.containment(F.col("wa"), F.col("wb")), 6).alias("overlap"))
