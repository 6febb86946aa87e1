"""Event log, links and topics, chunks, merges."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunks, discovery, events, graph, merges
from lodestone.queries import query
from lodestone.sources.tables import table
from lodestone.streaming.events import folder_for

_LOG = """log AS (
  SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS "at", 'order' AS entity, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'source_summarized' WHEN 'P' THEN 'source_failed' ELSE 'source_created' END AS kind FROM orders
  UNION ALL SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'event', event_id, CASE event_type WHEN 'error' THEN 'item_enrichment_failed' ELSE 'item_captured' END FROM events
  UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ'), 'line', l_orderkey * 10 + l_linenumber, 'blocked' FROM lineitem WHERE l_returnflag = 'R')"""


def review_log(spark, folder):
    """(at, entity, id, kind) of all branches."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")
    orders = table(spark, folder, "orders").select(iso("o_orderdate"), F.lit("order").alias("entity"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "source_summarized").when(F.col("o_orderstatus") == "P", "source_failed").otherwise("source_created").alias("kind"))
    clicks = table(spark, folder, "events").select(iso("ts"), F.lit("event").alias("entity"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "item_enrichment_failed").otherwise("item_captured").alias("kind"))
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(iso("l_shipdate"), F.lit("line").alias("entity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("blocked").alias("kind"))
    return events.event_log([orders, clicks, lines])


@query(f"""WITH {_LOG} SELECT entity, kind, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM log GROUP BY 1, 2""")
def review_events(spark, folder):
    return review_log(spark, folder).groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(f"""WITH {_LOG} SELECT * FROM log WHERE ("at", entity, id, kind) > ('1998-03-01T00:00:00Z', 'order', 100, 'source_failed') ORDER BY "at", entity, id, kind LIMIT 200""")
def review_page(spark, folder):
    """A page after a cursor, without gaps or overlaps at equal times."""
    return events.page(review_log(spark, folder), ["at", "entity", "id", "kind"], ["1998-03-01T00:00:00Z", "order", 100, "source_failed"], 200)


@query(f"""WITH {_LOG} SELECT kind, entity, least(greatest(40 + CASE WHEN kind IN ('blocked', 'source_failed', 'item_enrichment_failed') THEN 50 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 30 ELSE 0 END
 + CASE WHEN id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 10 ELSE 0 END - CASE WHEN kind = 'source_created' THEN 10 ELSE 0 END, 0), 100) AS importance, count(*) AS n FROM log GROUP BY 1, 2, 3""")
def review_importance(spark, folder):
    every = lambda n: F.col("id") % n == 0
    score = events.importance(F.col("kind"), F.when(every(3), "s").otherwise(" "), F.when(every(2), F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")), F.when(every(5), "github_star").otherwise("web"))
    return review_log(spark, folder).groupBy("kind", "entity", score.alias("importance")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT unnest(range(1705708800, 1706313600 + 1, 43200)) AS start), c AS (SELECT CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) AS start, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT s.start, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM s LEFT JOIN c USING (start) WHERE s.start > 1705708800""")
def activity_trend(spark, folder):
    """A week in buckets of twelve hours, empty ones included."""
    rows = table(spark, folder, "events")
    return events.trend(rows, "ts", F.col("event_type") != "error", datetime(2024, 1, 27, 3, tzinfo=timezone.utc), 168)


_URL = r"""u AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '^m\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT page_id, host, 'https://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END ||
  CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS url, lower(path) AS path FROM (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND split_part(lower(p), '=', 1) NOT IN ('fbclid', 'gclid', 'igshid', 'ref_src', 'si')) AS k FROM u))"""


@query(f"WITH {_URL} SELECT page_id, url, CASE WHEN path LIKE '%.pdf' THEN 'pdf' ELSE 'web' END AS kind, host, 'src:' || substr(sha256(url), 1, 12) AS key FROM n")
def normalised_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.normalised_url(F.col("url")).alias("u")).where("u is not null").select("page_id", "u.url", "u.kind", "u.host", "u.key")


@query(rf"""WITH {_URL}, l AS (SELECT p.page_id AS item, o.page_id - p.page_id AS position, o.url AS raw, n.url, n.host, 'src:' || substr(sha256(n.url), 1, 12) AS key FROM pages p JOIN pages o ON o.page_id IN (p.page_id, p.page_id + 1) JOIN n ON n.page_id = o.page_id),
e AS (SELECT item, key, min_by(raw, position) AS original_url, CASE WHEN item % 2 = 0 THEN 1 ELSE 2 END AS version FROM l GROUP BY item, key),
s AS (SELECT key, min_by(url, (version, item, position)) AS url, min_by(item, (version, item, position)) AS first_item, min_by(raw, (version, item, position)) AS first_url, min(version) AS source_version FROM (SELECT *, CASE WHEN item % 2 = 0 THEN 1 ELSE 2 END AS version FROM l) GROUP BY key)
SELECT item, key AS source_key, url, original_url, version, first_item, first_url, source_version FROM e JOIN s USING (key)""")
def link_discovery(spark, folder):
    """Sources and edges after three steps: pages of even ids, all pages, all again, which adds nothing."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    items = pages.join(after, "page_id", "left").select("page_id", F.array("url", "next", F.concat("url", F.lit("#again")), F.lit("not an address")).alias("links"))
    root = folder_for(spark, "links")
    for rows in (items.where("page_id % 2 = 0"), items, items):
        discovery.discover(rows, "page_id", "links", root)
    sources = discovery.read(spark, root, "sources").select("source_key", "url", "first_item", "first_url", F.col("version").alias("source_version"))
    return discovery.read(spark, root, "edges").join(sources, "source_key").select("item", "source_key", "url", "original_url", "version", "first_item", "first_url", "source_version")


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS links FROM pages WHERE len(regexp_extract_all(html, 'href="([^"]+)"', 1)) > 0""")
def page_links(spark, folder):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return table(spark, folder, "pages").select("page_id", F.size(found).cast("long").alias("links")).where("links > 0")


@query("""
WITH w AS (SELECT conv_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 4) AS w FROM conversations),
g AS (SELECT DISTINCT conv_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM w)
SELECT phrase, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 5""")
def phrase_counts(spark, folder):
    """Words and word pairs by the conversations that have them."""
    rows = table(spark, folder, "conversations").select("conv_id", F.explode(graph.grams(F.col("text"), 2, 4)).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count_distinct("conv_id").alias("n")).where("n > 5")


@query()
def topic_signals(spark, folder):
    """Phrases that many conversations share, none inside another; the last choice is greedy."""
    return graph.signal_clusters(table(spark, folder, "conversations"), "conv_id", F.col("text"), least_length=4, stop=("that", "with", "from", "this"))


@query("""
SELECT p_brand AS entity_key, coalesce(min_by(p_name, p_partkey) FILTER (WHERE p_partkey % 2 = 1), '') AS name, coalesce(min_by('u' || p_partkey, p_partkey) FILTER (WHERE p_partkey % 3 = 0), '') AS url,
 array_to_string(list_sort(list_distinct(list(p_type))), ',') AS aliases, min(p_type) AS kind, count(DISTINCT p_size) AS refs FROM part GROUP BY 1""")
def merged_entities(spark, folder):
    part = table(spark, folder, "part")
    mentions = part.select(F.col("p_brand").alias("entity_key"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("u"), F.col("p_partkey"))).otherwise("").alias("url"), F.col("p_type").alias("alias"), F.col("p_type").alias("kind"), F.col("p_size").alias("ref"))
    return graph.merged_entities(mentions).withColumn("aliases", F.array_join("aliases", ","))


@query("""
WITH e AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), t AS (SELECT a AS seed, b AS neighbour FROM e UNION ALL SELECT b, a FROM e),
g AS (SELECT seed, neighbour, count(*) AS n FROM t WHERE seed < 50 OR seed BETWEEN 1000000 AND 1000049 GROUP BY 1, 2)
SELECT seed, neighbour, n FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, neighbour) AS r FROM g) WHERE r <= 2""")
def topic_neighbours(spark, folder):
    edges = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    seeds = spark.range(50).union(spark.range(1000000, 1000050)).withColumnRenamed("id", "seed")
    return graph.one_hop(seeds, edges, 2)


@query("""
WITH l AS (SELECT DISTINCT c_custkey AS left_key, t FROM (SELECT c_custkey, unnest([lower(c_mktsegment), 'n' || c_nationkey]) AS t FROM customer)),
r AS (SELECT DISTINCT s_suppkey AS right_key, t FROM (SELECT s_suppkey, unnest(['n' || s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'building' ELSE 'machinery' END]) AS t FROM supplier)),
k AS (SELECT left_key, array_to_string(list_sort(list(t)), ',') AS k FROM l GROUP BY 1)
SELECT left_key, first AS class_id, coalesce(links, 0) AS links, coalesce(shared, 0) AS shared FROM k JOIN (SELECT k, min(left_key) AS first FROM k GROUP BY 1) USING (k)
LEFT JOIN (SELECT left_key, count(DISTINCT right_key) AS links, count(*) AS shared FROM l JOIN r USING (t) GROUP BY 1) USING (left_key)""")
def related_by_token(spark, folder):
    """Customers and the suppliers that they share tokens with, as links of classes with equal tokens."""
    number = lambda c: F.concat(F.lit("n"), F.col(c))
    left = table(spark, folder, "customer").select(F.col("c_custkey").alias("left_key"), F.explode(F.array(F.lower("c_mktsegment"), number("c_nationkey"))).alias("t"))
    half = F.when(F.col("s_suppkey") % 2 == 0, "building").otherwise("machinery")
    return graph.linked_classes(left, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("right_key"), F.explode(F.array(number("s_nationkey"), half)).alias("t")), "t")


@query()
def document_chunks(spark, folder):
    """Content-defined chunks of all documents."""
    return chunks.chunked(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "ordinal", "start", "end", F.sha2("text", 256).alias("digest"))


@query("""
WITH c AS (SELECT doc_id, md5(substr(text, 200 * i + 1, 200)) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents) UNION ALL SELECT doc_id, 'everywhere' FROM documents)
SELECT chunk, least(count(DISTINCT doc_id), 4) AS n FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def capped_occurrences(spark, folder):
    """Pieces of 200 characters by how many documents have them, 4 for more than three; one stands in every document."""
    docs = table(spark, folder, "documents")
    places = F.explode(F.concat(F.transform(F.filter(F.sequence(F.lit(0), F.ceil(F.length("text") / 200).cast("int")), lambda i: i * 200 < F.length("text")), lambda i: F.md5(F.substring(F.col("text"), i * 200 + 1, F.lit(200)))), F.array(F.lit("everywhere"))))
    return chunks.capped_counts(docs.select("doc_id", places.alias("chunk")), "chunk", "doc_id", 3).where("n > 1")


@query("""
WITH c AS (SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 2 = 0 THEN 'item' ELSE 'source' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey % 50 END AS parent, o_totalprice AS price FROM orders),
p AS (SELECT 'item' AS kind, c_custkey AS parent, c_name AS title FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'source', s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT chunk_id, kind, parent, price, title FROM c JOIN p USING (kind, parent) WHERE chunk_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 < 2 ORDER BY o_orderkey LIMIT 900)""")
def chunk_hydration(spark, folder):
    """Chunks of a search with the fields of their parents, items and sources alike."""
    orders, even = table(spark, folder, "orders"), F.col("o_orderkey") % 2 == 0
    rows = orders.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.when(even, "item").otherwise("source").alias("kind"), F.when(even, F.col("o_custkey")).otherwise(F.col("o_custkey") % 50).alias("parent"), F.col("o_totalprice").alias("price"))
    items = table(spark, folder, "customer").select(F.lit("item").alias("kind"), F.col("c_custkey").alias("parent"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 != 0, "note").otherwise(" ").alias("note"), F.lit(True).alias("current"))
    sources = table(spark, folder, "supplier").select(F.lit("source").alias("kind"), F.col("s_suppkey").alias("parent"), F.col("s_name").alias("title"), F.lit("note").alias("note"), (F.col("s_suppkey") % 5 != 0).alias("current"))
    asked = orders.where("o_orderkey % 4 < 2").orderBy("o_orderkey").limit(900).select(F.concat(F.lit(" "), F.col("o_orderkey")).alias("chunk_id"))
    return chunks.hydrated(asked, rows, [items, sources]).select(F.col("chunk_id").cast("long").alias("chunk_id"), "kind", "parent", "price", "title")


@query("""
WITH o AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS d FROM documents WHERE doc_id % 6 <> 0)
SELECT count(*) FILTER (WHERE o.d IS NULL) AS created, count(*) FILTER (WHERE o.d <> n.d) AS updated, count(*) FILTER (WHERE o.d = n.d) AS reused, count(*) FILTER (WHERE n.d IS NULL) AS deleted FROM o FULL JOIN n USING (doc_id)""")
def projection_difference(spark, folder):
    docs = table(spark, folder, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("d"))
    new = docs.where("doc_id % 6 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("d"))
    return chunks.difference(old, new, ["doc_id"], "d")


@query("""
WITH a AS (SELECT c_custkey AS k, md5(c_name || c_mktsegment) AS h, c_mktsegment AS s FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS k, md5(c_name || CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END) AS h, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.h WHEN a.k IS NULL OR a.h <> b.h THEN b.h ELSE a.h END AS h, CASE WHEN b.k IS NULL OR a.h = b.h THEN a.s ELSE coalesce(nullif(b.s, ''), a.s, b.s) END AS s,
 CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'created' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.k = b.k""")
def item_upsert(spark, folder):
    five = F.col("c_custkey") % 5 == 0
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment", five.alias("five"))
    current = rows.where("k % 4 <> 0").select("k", F.md5(F.concat("c_name", "c_mktsegment")).alias("h"), F.col("c_mktsegment").alias("s"))
    changed = F.when(F.col("five"), "X").otherwise(F.col("c_mktsegment"))
    batch = rows.where("k % 3 <> 0").select("k", F.md5(F.concat("c_name", changed)).alias("h"), F.when(F.col("k") % 10 == 0, "").otherwise(changed).alias("s"))
    return merges.upsert(current, batch, "k", "h", keep=["s"])


@query("""
WITH a AS (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey AS k, md5(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END) AS h FROM part WHERE p_partkey % 3 <> 0)
SELECT action, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions FROM (SELECT CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'created' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS action,
 CASE WHEN b.k IS NULL OR a.h = b.h THEN 1 WHEN a.k IS NULL THEN 1 ELSE 2 END AS version FROM a FULL JOIN b USING (k)) GROUP BY 1""")
def entry_versions(spark, folder):
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "k")
    entries = part.where("k % 4 <> 0").select("k", F.md5("p_name").alias("h"), F.lit(1).alias("version"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-01").alias("last_seen"))
    batch = part.where("k % 3 <> 0").select("k", F.md5(F.when(F.col("k") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("h"), F.lit("2024-02-01").alias("at"))
    after, _ = merges.apply_versions(entries, batch, "k", "h", "at")
    return after.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')) AS children,
 (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')) AS touched""")
def cascade_delete(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    parents, children, touched = merges.cascade_delete(orders, lines, "k", F.col("o_orderpriority") == "5-LOW")
    one = lambda df, name, c: df.agg(c.alias(name))
    n = F.count(F.lit(1))
    return one(parents, "parents", n).crossJoin(one(children, "children", n)).crossJoin(one(touched, "touched", F.count_distinct("l_partkey")))  # three rows of one value


@query("SELECT event_type, CASE WHEN user_id % 5 >= 3 THEN 'dead' ELSE 'pending' END AS state, count(*) AS n FROM events GROUP BY 1, 2")
def dead_letters(spark, folder):
    return merges.dead_letters(table(spark, folder, "events").withColumn("attempts", F.col("user_id") % 5), "attempts", 3).groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE t1 WHEN 'ring' THEN 'band' ELSE t1 END, CASE WHEN t2 = t1 THEN '' ELSE CASE t2 WHEN 'ring' THEN 'band' ELSE t2 END END], lambda x: x NOT IN ('', 'small')), ',') AS tags
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2 FROM part)""")
def tag_vocabulary(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.array_join(merges.vocabulary(F.split("p_name", " "), {"ring": "band"}, ("small",)), ",").alias("tags"))


@query("""
SELECT status, n, count(*) AS rows FROM (SELECT event_type AS status, CASE WHEN event_type <> 'error' THEN 0 WHEN user_id % 2 = 0 AND event_id % 3 > 0 THEN event_id % 3 + 1 ELSE 1 END AS n FROM events) GROUP BY 1, 2""")
def failure_series(spark, folder):
    state = merges.failure_state(F.col("event_type") == "error", F.col("user_id") % 2 == 0, (F.col("event_id") % 3).cast("int"), F.lit(""), F.lit("2024-02-01T00:00:00Z"))
    return table(spark, folder, "events").select(F.col("event_type").alias("status"), state["count"].cast("long").alias("n")).groupBy("status", "n").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def model_answers(spark, folder):
    """Values from answers that wrap their JSON in a fence and talk."""
    answer = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, folder, "events").select("event_id", merges.parsed_answer(answer, "k long")["k"].alias("k"))
