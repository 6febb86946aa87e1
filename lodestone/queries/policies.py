"""Work policies, readiness, evidence rules, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import graph, hydration, readiness
from lodestone.operators import windows as W
from lodestone.queries import query
from lodestone.sources import tables
from lodestone.sources.tables import table


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-01-01') OR o_orderkey % 13 <> o_custkey % 13 OR o_orderpriority <> '1-URGENT'""")
def summary_stale(spark, folder):
    """Without a summary, failed and due, made from other content, or by another prompt."""
    status, due = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd") <= "1997-01-01"
    stale = (status == "O") | ((status == "P") & due) | (F.col("o_orderkey") % 13 != F.col("o_custkey") % 13) | (F.col("o_orderpriority") != "1-URGENT")
    return table(spark, folder, "orders").where(stale).select("o_orderkey")


@query("""
SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE o_orderstatus WHEN 'P' THEN o_custkey % 4 ELSE 0 END, o_orderpriority, o_orderdate, o_orderkey DESC LIMIT 250""")
def candidate_order(spark, folder):
    """The work list: by state, failures, kind and time, newest id first."""
    status = F.col("o_orderstatus")
    rank = F.when(status == "O", 0).when(status == "P", 1).otherwise(2)
    return table(spark, folder, "orders").orderBy(rank, F.when(status == "P", F.col("o_custkey") % 4).otherwise(0), "o_orderpriority", "o_orderdate", F.desc("o_orderkey")).limit(250).select("o_orderkey")


@query("""
WITH items AS (SELECT o_orderkey AS item, CASE o_custkey % 3 WHEN 0 THEN 'x_quote' ELSE 'x_bookmark' END AS source_type, CASE o_orderstatus WHEN 'O' THEN 'ok_graphql' WHEN 'P' THEN 'error' ELSE 'ok_web' END AS status,
  CASE WHEN o_custkey % 5 = 0 THEN '{"broken' WHEN o_custkey % 5 = 1 THEN '{"snapshot":{"media_objects":[{"type":"photo"}]},"tweetResult":1}' WHEN o_custkey % 5 = 2 THEN '{"quoted_tweet":' || o_custkey || '}'
   ELSE '{"raw":{"data":{"tweetResult":{"result":{"note_tweet":{"note_tweet_results":{"result":{"entity_set":{"urls":[{"expanded_url":"https://a/' || (o_custkey % 4) || '"},{}]}}}}}}}}}' END AS post, '["https://a/1","https://a/2"]' AS links FROM orders),
links AS (SELECT l_orderkey AS item, l_partkey AS asset FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 <> 0),
assets AS (SELECT p_partkey AS asset, CASE p_size % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'error' WHEN 2 THEN 'gone' ELSE 'downloaded' END AS status, p_size % 5 AS errors, CASE WHEN p_size % 2 = 0 THEN '' ELSE '2024-01-0' || (p_size % 9 + 1) || 'T00:00:00Z' END AS last_attempt,
  CASE WHEN p_partkey % 2 = 0 THEN 'video' ELSE 'photo' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN '/a.jpg' ELSE '/a.mp4' END AS path, 'https://other/' AS url FROM part),
quotes AS (SELECT l_orderkey AS item, 'quoted_post' AS kind FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT item, source_type, status,
  CASE WHEN json_valid(post) THEN json_extract_string(post, '$.snapshot.media_objects[0].type') IS NOT NULL ELSE false END AND (NOT EXISTS (SELECT 1 FROM links l WHERE l.item = items.item)
   OR EXISTS (SELECT 1 FROM links l, assets a WHERE l.item = items.item AND a.asset = l.asset AND (a.status IN ('', 'pending') OR a.status = 'error' AND a.errors < 3 AND (a.last_attempt = '' OR a.last_attempt <= '2024-01-05T00:00:00Z')))
   OR EXISTS (SELECT 1 FROM links l, assets a WHERE l.item = items.item AND a.asset = l.asset AND a.status = 'downloaded' AND a.kind IN ('video', 'animated_gif') AND (a.path LIKE '%.jpg' OR a.url LIKE 'https://pbs.twimg.com/%'))) AS media_repair,
  contains(post, '"quoted_tweet"') AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.item = items.item AND q.kind = 'quoted_post') AS quote_repair,
  source_type = 'x_quote' AND status = 'ok_graphql' AND NOT contains(post, '"tweetResult"') AS direct_repair,
  contains(post, 'expanded_url') AND regexp_extract(post, 'https://a/[0-9]') NOT IN ('https://a/1', 'https://a/2') AS note_repair FROM items)
SELECT item, media_repair, quote_repair, direct_repair, note_repair, status IN ('', 'api_error', 'error', 'rate_limited') OR starts_with(status, 'ok_') AND (media_repair OR quote_repair OR direct_repair OR note_repair) AS candidate FROM f""")
def hydration_candidates(spark, folder):
    """Posts to fetch again: by state, by their media, by quotes and addresses that are missing."""
    orders, lines, part = table(spark, folder, "orders"), table(spark, folder, "lineitem"), table(spark, folder, "part")
    key, size = F.col("o_custkey"), F.col("p_size")
    note = F.concat(F.lit('{"raw":{"data":{"tweetResult":{"result":{"note_tweet":{"note_tweet_results":{"result":{"entity_set":{"urls":[{"expanded_url":"https://a/'), key % 4, F.lit('"},{}]}}}}}}}}}'))
    post = F.when(key % 5 == 0, '{"broken').when(key % 5 == 1, '{"snapshot":{"media_objects":[{"type":"photo"}]},"tweetResult":1}').when(key % 5 == 2, F.concat(F.lit('{"quoted_tweet":'), key, F.lit("}"))).otherwise(note)
    status = F.when(F.col("o_orderstatus") == "O", "ok_graphql").when(F.col("o_orderstatus") == "P", "error").otherwise("ok_web")
    items = orders.select(F.col("o_orderkey").alias("item"), F.when(key % 3 == 0, "x_quote").otherwise("x_bookmark").alias("source_type"), status.alias("status"), post.alias("post"), F.lit('["https://a/1","https://a/2"]').alias("links"))
    links = lines.where("l_linenumber = 1 and l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("asset"))
    state = F.when(size % 4 == 1, "error").when(size % 4 == 2, "gone").otherwise("downloaded")
    last = F.when(size % 2 == 0, "").otherwise(F.concat(F.lit("2024-01-0"), size % 9 + 1, F.lit("T00:00:00Z")))
    assets = part.select(F.col("p_partkey").alias("asset"), state.alias("status"), (size % 5).alias("errors"), last.alias("last_attempt"), F.when(F.col("p_partkey") % 2 == 0, "video").otherwise("photo").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, "/a.jpg").otherwise("/a.mp4").alias("path"), F.lit("https://other/").alias("url"))
    quotes = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item"), F.lit("quoted_post").alias("kind"))
    return hydration.hydration(items, links, assets, quotes, "2024-01-06T00:00:00Z").drop("source_type", "status", "post", "links")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def quoted_repair(spark, folder):
    edges = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return table(spark, folder, "orders").where("o_orderstatus <> 'F'").join(edges, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 NOT IN (1, 2, user_id % 10)")
def json_link_repair(spark, folder):
    """Rows whose JSON names something that their list lacks."""
    named = F.array(F.from_json("props", "k long")["k"] % 10)
    have = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("user_id") % 10)
    return table(spark, folder, "events").where(F.exists(named, lambda x: ~F.array_contains(have, x))).select("event_id")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(least(30 * power(2, least(greatest(user_id % 9 - 1, 0), 40)), 3600)) AS BIGINT) AS seconds FROM events GROUP BY 1""")
def retry_backoff(spark, folder):
    wait = readiness.backoff((F.col("user_id") % 9).cast("int"), 30, 3600)
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(wait).alias("seconds"))


@query("""
WITH s AS (SELECT label, count(*) FILTER (WHERE vec_id % 7 > 0) AS ready, count(*) FILTER (WHERE vec_id % 7 = 0 AND label = 3) AS blocked, count(*) AS chunks, count(*) FILTER (WHERE vec_id % 5 = 0) AS l0, count(*) FILTER (WHERE vec_id % 40 = 0) AS dead, count(*) AS indexed,
 count(*) FILTER (WHERE label = 9 AND vec_id % 3 = 0) AS corrupt, label % 2 = 0 AS active FROM embeddings GROUP BY label)
SELECT label, CASE WHEN corrupt > 0 THEN 'corrupt' WHEN active AND (l0 > 10000 OR dead * 100 > greatest(indexed, 1) * 2) THEN 'needs_index' WHEN blocked * 1000 > chunks THEN 'degraded_blocked'
 WHEN ready + blocked = chunks AND NOT active AND ready > 25000 THEN 'needs_index' WHEN ready + blocked = chunks AND active AND (l0 > 5000 OR dead * 100 > greatest(indexed, 1)) THEN 'catching_up' WHEN ready + blocked = chunks THEN 'ready' ELSE 'needs_embeddings' END AS state FROM s""")
def readiness_states(spark, folder):
    every, label = (lambda n: F.col("vec_id") % n == 0), F.col("label")
    counts = table(spark, folder, "embeddings").groupBy("label").agg(F.count_if(~every(7)).alias("ready"), F.count_if(every(7) & (label == 3)).alias("blocked"), F.count(F.lit(1)).alias("chunks"), F.count_if(every(5)).alias("l0"), F.count_if(every(40)).alias("dead"), F.count(F.lit(1)).alias("indexed"), F.count_if((label == 9) & every(3)).alias("corrupt"))
    snapshot = F.struct("ready", "blocked", "chunks", "l0", "dead", "indexed", "corrupt", (label % 2 == 0).alias("active"))
    return counts.select("label", readiness.decision(snapshot).alias("state"))


@query("""
WITH g AS (SELECT c_custkey AS generation, c_nationkey AS profile, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS published, c_custkey % 50 = 1 AS active FROM customer),
k AS (SELECT generation FROM g WHERE active OR generation % 10 = 7 UNION SELECT max_by(generation, published) FROM g WHERE published > 0 GROUP BY profile),
m AS (SELECT DISTINCT o_custkey AS generation, o_orderkey % 4000 AS segment FROM orders)
SELECT DISTINCT segment FROM m WHERE segment NOT IN (SELECT segment FROM m JOIN k USING (generation))""")
def segment_gc(spark, folder):
    key = F.col("c_custkey")
    generations = table(spark, folder, "customer").select(key.alias("generation"), F.col("c_nationkey").alias("profile"), F.when(key % 3 == 0, key).otherwise(0).alias("published"), (key % 50 == 1).alias("active"))
    members = table(spark, folder, "orders").select(F.col("o_custkey").alias("generation"), (F.col("o_orderkey") % 4000).alias("segment")).distinct()
    return readiness.expendable(generations, members, F.col("generation") % 10 == 7)


@query("SELECT count(*) AS pages, count(*) FILTER (WHERE vec_id % 9 = 0) AS changed FROM embeddings")
def verify_vectors(spark, folder):
    """Vectors hashed again and compared with what was stored."""
    from lodestone.operators.vectors import encode

    rows = table(spark, folder, "embeddings").select("vec_id", F.sha2(encode(F.col("embedding")), 256).alias("now"))
    stored = F.when(F.col("vec_id") % 9 == 0, F.lit("?")).otherwise(F.col("now"))
    return rows.withColumn("stored", stored).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("stored") != F.col("now")).alias("changed"))


@query(r"""
SELECT conv_id, array_to_string(list_sort(list_distinct(regexp_extract_all('see doc:' || conv_id || ', doc:' || (turn * 3) || ' and src:ab12', '(?:doc|src):[a-z0-9]+'))), ' ') AS keys,
 turn * 3 <> conv_id AS more FROM conversations WHERE turn = 1""")
def citation_keys(spark, folder):
    answer = F.concat(F.lit("see doc:"), F.col("conv_id"), F.lit(", doc:"), F.col("turn") * 3, F.lit(" and src:ab12"))
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit("((?:doc|src):[a-z0-9]+)"), 1)))
    allowed = F.array(F.lit("src:ab12"), F.concat(F.lit("doc:"), F.col("conv_id")))
    return table(spark, folder, "conversations").where("turn = 1").select("conv_id", F.array_join(keys, " ").alias("keys"), (F.size(F.array_except(keys, allowed)) > 0).alias("more"))


@query("""
WITH a AS (SELECT 'c:' || c_custkey AS near FROM customer), w AS (SELECT 'c:' || (c_custkey + 150) AS key FROM customer)
SELECT key, near, distance FROM (SELECT key, near, levenshtein(key, near) AS distance, row_number() OVER (PARTITION BY key ORDER BY levenshtein(key, near), near) AS r FROM w, a WHERE levenshtein(key, near) <= 2) WHERE r = 1""")
def nearest_allowed_keys(spark, folder):
    key = lambda add: F.concat(F.lit("c:"), F.col("c_custkey") + add).alias("key")
    customers = table(spark, folder, "customer")
    return E.nearest_keys(customers.select(key(150)), customers.select(key(0))).withColumn("distance", F.col("distance").cast("long"))


@query("""
WITH r AS (SELECT conv_id, turn, list_filter(['que', 'that', 'der', 'zebra'], lambda c: NOT contains(lower(text), c)) AS missing FROM conversations)
SELECT conv_id, concept FROM (SELECT conv_id, unnest(missing) AS concept FROM r) JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY 1) USING (conv_id) GROUP BY conv_id, concept, n HAVING count(*) = n""")
def missing_concepts(spark, folder):
    """What no row of a group has."""
    low = F.lower("text")
    missing = F.filter(F.array(*map(F.lit, ("que", "that", "der", "zebra"))), lambda c: ~F.contains(low, c))
    return E.always_missing(table(spark, folder, "conversations").select("conv_id", missing.alias("missing")), "conv_id", "missing")


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_id % 2 = 0) > 0 THEN strftime(max(ts) FILTER (WHERE event_id % 2 = 0), '%Y-%m-%dT%H:%M:%SZ') ELSE 'odd' END AS latest FROM events GROUP BY 1""")
def latest_evidence(spark, folder):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("odd")
    return table(spark, folder, "events").groupBy("user_id").agg(E.latest_in_group(text).alias("latest"))


@query(r"""
WITH o AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN position('. ' IN t) > 1 THEN substr(t, 1, position('. ' IN t)) WHEN position('? ' IN t) > 1 THEN substr(t, 1, position('? ' IN t)) WHEN position('! ' IN t) > 1 THEN substr(t, 1, position('! ' IN t)) ELSE substr(t, 1, 220) END AS sentence FROM o""")
def best_sentences(spark, folder):
    return table(spark, folder, "documents").select("doc_id", E.best_sentence(F.col("text")).alias("sentence"))


_WINDOWS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
p AS (SELECT doc_id, term, piece, k, length(term) AS n FROM (SELECT doc_id, term, unnest(string_split(low, term)) AS piece, generate_subscripts(string_split(low, term), 1) AS k FROM d, (VALUES ('licensed'), ('under'), ('token')) AS v(term))),
h AS (SELECT doc_id, term, n, k, max(k) OVER (PARTITION BY doc_id, term) - 1 AS often, sum(length(piece) + n) OVER (PARTITION BY doc_id, term ORDER BY k) - n AS pos FROM p),
w AS (SELECT DISTINCT h.doc_id, h.n, greatest(least(pos - 40, length(low) - 160), 0) AS start, low FROM h JOIN d USING (doc_id) WHERE k <= often),
c AS (SELECT DISTINCT doc_id, term, n, often FROM h),
s AS (SELECT w.doc_id, w.start, w.n + sum(CASE WHEN contains(substr(low, CAST(start AS BIGINT) + 1, 160), c.term) THEN 100 + 1000 // greatest(often, 1) + c.n ELSE 0 END) AS score FROM w JOIN c USING (doc_id) GROUP BY w.doc_id, w.start, w.n, w.low),
b AS (SELECT doc_id, CAST(max(score) AS INT) AS score, CAST(arg_min(start, (-score, start)) AS BIGINT) AS start FROM s GROUP BY doc_id)"""


@query(_WINDOWS + r"""
SELECT doc_id, coalesce(score, 0) AS score, coalesce(CASE WHEN start > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, start + 1, 160), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') || CASE WHEN start + 160 < length(text) THEN '...' ELSE '' END, '') AS "window" FROM d LEFT JOIN b USING (doc_id)""")
def query_windows(spark, folder):
    """The best stretch of each text for some terms, empty where none occurs."""
    found = table(spark, folder, "documents").select("doc_id", E.best_window(F.col("text"), ["licensed", "under", "token"]).alias("w"))
    return found.select("doc_id", F.coalesce("w.score", F.lit(0)).alias("score"), F.coalesce("w.text", F.lit("")).alias("window"))


@query("""
SELECT p_partkey, CASE WHEN p_name = 'red ring' OR lower(p_type) = 'red ring' THEN 10 WHEN contains(p_name, 'red ring') THEN 6 ELSE 0 END AS score FROM part""")
def entity_scores(spark, folder):
    return table(spark, folder, "part").select("p_partkey", E.text_score(F.array(F.col("p_name"), F.lower("p_type")), "red ring").alias("score"))


@query("""
SELECT p_brand, matched * 20 + least(refs, 10) + 3 + CASE WHEN p_brand = 'Brand#1' THEN 16 WHEN contains(p_brand, 'Brand#1') THEN 12 WHEN contains(p_brand, 'Brand') THEN 4 ELSE 0 END AS score
FROM (SELECT p_brand, count(*) FILTER (WHERE p_size < 3) AS matched, count(*) AS refs FROM part GROUP BY 1)""")
def topic_entities(spark, folder):
    counts = table(spark, folder, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 3).alias("matched"), F.count(F.lit(1)).alias("refs"))
    return counts.select("p_brand", E.topic_score(F.col("matched"), F.col("refs"), F.lit(3), F.array("p_brand"), "Brand#1", ["Brand"]).alias("score"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '^m\.', '') AS host FROM pages)
SELECT CASE WHEN len(string_split(host, '.')) > 2 AND list_extract(string_split(host, '.'), -2) IN ('co', 'com', 'net', 'org') THEN list_extract(string_split(host, '.'), -3) ELSE list_extract(string_split(host, '.'), -2) END AS brand, count(*) AS n FROM h GROUP BY 1""")
def brands(spark, folder):
    return table(spark, folder, "pages").groupBy(E.brand(T.url_host(F.col("url"))).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT token, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(url), '[@/_\-.:\s]+'), lambda t: length(t) >= 4)) AS token FROM pages) GROUP BY 1""")
def identity_tokens(spark, folder):
    tokens = table(spark, folder, "pages").select("page_id", F.explode(E.identity_tokens(F.col("url"))).alias("token"))
    return tokens.groupBy("token").agg(F.count_distinct("page_id").alias("n"))


@query("""
SELECT source, CAST(epoch(TIMESTAMP '2024-02-01') - epoch(last) AS BIGINT) > 43200 AS late, arrivals FROM
(SELECT 'u' || user_id % 10 AS source, max(ts) AS last, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS arrivals FROM events GROUP BY 1)""")
def import_freshness(spark, folder):
    """Last arrival of each source against a deadline, and how many came lately."""
    ts = F.col("ts").cast("timestamp")
    found = table(spark, folder, "events").groupBy(F.concat(F.lit("u"), F.col("user_id") % 10).alias("source")).agg(F.max(ts).alias("last"), F.count_if(ts >= F.to_timestamp(F.lit("2024-01-29"))).alias("arrivals"))
    return found.select("source", (F.unix_seconds(F.to_timestamp(F.lit("2024-02-01"))) - F.unix_seconds("last") > 43200).alias("late"), "arrivals")


@query("""
SELECT p_type AS tag, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_type IN ('PROMO', 'SMALL')) WHERE r <= 8""")
def exact_tag_lane(spark, folder):
    rows = table(spark, folder, "part").where(F.col("p_type").isin("PROMO", "SMALL"))
    return W.cap_per_group(rows, ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 8).select(F.col("p_type").alias("tag"), "p_partkey")


@query("""
SELECT DISTINCT p_partkey FROM part WHERE p_size < 5 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3') AND (contains(p_name, 'ring') OR p_type = 'PROMO')""")
def retry_merge(spark, folder):
    """Rows of a second try that are new and fill a gap."""
    part = table(spark, folder, "part")
    first, second = part.where("p_brand = 'Brand#3'"), part.where("p_size < 5")
    return second.join(first.select("p_partkey"), "p_partkey", "left_anti").where(F.contains("p_name", F.lit("ring")) | (F.col("p_type") == "PROMO")).select("p_partkey").distinct()


@query(r"""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS target FROM pages)
SELECT page_id, count(*) AS broken FROM l WHERE target NOT IN (SELECT regexp_extract(html, 'href="/([A-Za-z]+)"', 1) FROM pages WHERE page_id % 2 = 0) GROUP BY 1""")
def broken_links(spark, folder):
    """Links that lead nowhere, by page."""
    pages = table(spark, folder, "pages")
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), 1))).alias("target"))
    known = pages.where("page_id % 2 = 0").select(F.regexp_extract("html", 'href="/([A-Za-z]+)"', 1).alias("path"))
    return E.missing_targets(links, known, "target", "path").groupBy("page_id").agg(F.count(F.lit(1)).alias("broken"))


@query("SELECT p_partkey, array_to_string(list_distinct_sorted, ',') AS tags FROM (SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1), 'fresh'] ELSE [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'fresh'] END AS list_distinct_sorted FROM part)")
def tag_merge(spark, folder):
    """Old tags, then new ones, each once."""
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lit("fresh")))), ",").alias("tags"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text, doc_id % 3 = 0 AS purged FROM documents)
SELECT count(*) AS rows, count(*) FILTER (WHERE purged) AS purged, count(*) FILTER (WHERE text = '') AS blank, (SELECT count(*) FROM labels WHERE doc_id % 3 <> 0) AS children FROM d""")
def purge_content(spark, folder):
    """Blank the text of some rows and drop what hangs on them."""
    gone = F.col("doc_id") % 3 == 0
    docs = table(spark, folder, "documents").select("doc_id", F.when(gone, "").otherwise(F.col("text")).alias("text"), gone.alias("purged"))
    children = table(spark, folder, "labels").join(docs.where("purged"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("children"))
    return docs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("purged")).alias("purged"), F.count_if(F.col("text") == "").alias("blank")).crossJoin(children)  # two rows of one value


@query("SELECT count(*) AS files_lines FROM nation")
def markdown_sink(spark, folder):
    """Notes written as text and read back."""
    from lodestone.streaming.events import folder_for

    out = folder_for(spark, "notes")
    note = F.concat(F.lit("# "), F.col("n_name"), F.lit(" (region "), F.col("n_regionkey"), F.lit(")"))
    table(spark, folder, "nation").select(note.alias("value")).write.text(out)
    return tables.whole_texts(spark, out).select(F.explode(F.split(F.rtrim(F.regexp_replace("value", r"\n+$", "")), "\n")).alias("line")).where(F.startswith("line", F.lit("# "))).agg(F.count(F.lit(1)).alias("files_lines"))


@query("""
WITH e AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), t AS (SELECT a AS seed, b AS neighbour FROM e UNION ALL SELECT b, a FROM e), g AS (SELECT seed, neighbour, count(*) AS n FROM t GROUP BY 1, 2),
k AS (SELECT seed, neighbour, n, row_number() OVER (PARTITION BY seed ORDER BY n DESC, neighbour) AS r FROM g),
s AS (SELECT p_partkey + 1000000 AS seed FROM part WHERE contains(p_name, 'red ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 6),
f AS (SELECT DISTINCT neighbour AS seed FROM k JOIN s USING (seed) WHERE r <= 2)
SELECT p_brand, count(DISTINCT seed) AS through, sum(n) AS links FROM k JOIN f USING (seed) JOIN part ON neighbour = p_partkey + 1000000 WHERE r <= 5 GROUP BY 1""")
def topic_map(spark, folder):
    """Seeds of a topic, their neighbours, and the brands that both lead to."""
    part = table(spark, folder, "part").withColumn("node", F.col("p_partkey") + 1000000)
    edges = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    seeds = part.where(F.contains("p_name", F.lit("red ring"))).orderBy(F.desc("p_retailprice"), "p_partkey").limit(6).select(F.col("node").alias("seed"))
    first = graph.one_hop(seeds, edges, 2)
    second = graph.one_hop(first.select(F.col("neighbour").alias("seed")).distinct(), edges, 5)
    return second.join(part, F.col("neighbour") == F.col("node")).groupBy("p_brand").agg(F.count_distinct("seed").alias("through"), F.sum("n").alias("links"))
