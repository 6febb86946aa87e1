"""Scans, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.queries import query
from lodestone.sources.tables import after, lookup, table


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 77 OR c_name = 'Customer#000000012'")
def point_lookup(spark, folder):
    """A row by any of its keys."""
    return lookup(table(spark, folder, "customer"), {"c_custkey": 77, "c_name": "Customer#000000012"}).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_name, p_partkey LIMIT 100")
def ordered_scan(spark, folder):
    return table(spark, folder, "part").orderBy("p_name", "p_partkey").limit(100).select("p_partkey", "p_name", "p_brand")


@query("SELECT DISTINCT source, lang FROM documents")
def narrow_scan(spark, folder):
    return table(spark, folder, "documents").select("source", "lang").distinct()


@query("""
WITH k AS (SELECT key FROM (SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier) WHERE key > 3 ORDER BY key LIMIT 12),
c AS (SELECT c_nationkey AS key, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS key, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT k.key, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM k LEFT JOIN c USING (key) LEFT JOIN s USING (key)""")
def keyset_two_tables(spark, folder):
    """A page of the keys of two tables after a cursor, then both tables' counts."""
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    keys = c.select(F.col("c_nationkey").alias("key")).union(s.select("s_nationkey")).distinct()
    page = keys.where("key > 3").orderBy("key").limit(12)
    customers = c.groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("customers"))
    suppliers = s.groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("suppliers"))
    return page.join(customers, "key", "left").join(suppliers, "key", "left").fillna(0, ["customers", "suppliers"])


@query("SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 50")
def keyset_vectors(spark, folder):
    return table(spark, folder, "embeddings").where("vec_id > 100").orderBy("vec_id").limit(50).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("""
SELECT o_orderkey, c_name, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def export_snapshot(spark, folder):
    """Parents with their ordered children in one row; children are gathered before the small side joins."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("held"))
    listed = F.transform("held", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "c_name", F.size("held").cast("long").alias("n"), F.array_join(listed, ",").alias("parts"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'guid:' || page_id WHEN page_id % 3 = 1 THEN 'link:' || lower(url)
  ELSE 'hash:' || sha256(lpad(hex(strlen(url)), 16, '0') || url) END AS identity FROM pages""".replace("sha256(lpad(hex(strlen(url)), 16, '0') || url)", "sha256(unhex(lpad(upper(to_hex(strlen(url))), 16, '0')) || encode(url))"))
def entry_identity(spark, folder):
    """Identity by the first that is there: guid, link, or a length-prefixed hash."""
    guid = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise("")
    link = F.when(F.col("page_id") % 3 == 1, F.lower("url")).otherwise("")
    given = lambda c, kind: F.concat(F.lit(f"{kind}:"), F.nullif(c, F.lit("")))
    return table(spark, folder, "pages").select("page_id", F.coalesce(given(guid, "guid"), given(link, "link"), F.concat(F.lit("hash:"), T.length_prefixed_sha256(F.col("url")))).alias("identity"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_attributes(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_events(spark, folder):
    return table(spark, folder, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT doc_id, position('license' IN lower(text)) AS at FROM documents WHERE contains(lower(text), 'license')")
def substring_search(spark, folder):
    low = F.lower("text")
    return table(spark, folder, "documents").where(F.contains(low, F.lit("license"))).select("doc_id", F.instr(low, "license").cast("long").alias("at"))


@query("""
WITH l AS (SELECT sha256('n' || c_nationkey) AS h FROM customer), r AS (SELECT DISTINCT sha256('n' || s_nationkey) AS h FROM supplier)
SELECT count(*) AS total, count(r.h) AS matched FROM l LEFT JOIN r USING (h)""")
def hashed_parity(spark, folder):
    """Identities that two tables share, compared as hashes."""
    hashed = lambda c: F.sha2(F.concat(F.lit("n"), F.col(c).cast("string")), 256).alias("h")
    theirs = table(spark, folder, "supplier").select(hashed("s_nationkey")).distinct().withColumn("there", F.lit(1))
    return table(spark, folder, "customer").select(hashed("c_nationkey")).join(theirs, "h", "left").agg(F.count(F.lit(1)).alias("total"), F.count("there").alias("matched"))


@query("""
SELECT doc_id, substr(trim(replace(coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END, ''), nullif(lang, ''), ''), chr(10), ' '), ' '), 1, 200) AS best FROM documents""")
def best_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.best_text(F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(""), F.col("lang")).alias("best"))


@query("""
SELECT family, count(*) AS n FROM (SELECT CASE WHEN position('_' IN k) > 1 THEN split_part(k, '_', 1) ELSE k END AS family
FROM (SELECT replace(o_orderpriority, '-', '_') AS k FROM orders)) GROUP BY 1""")
def type_family(spark, folder):
    kinds = table(spark, folder, "orders").select(F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("k"))
    return kinds.groupBy(T.family(F.col("k")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


_CSV = "replace(p_name, ' ', ', ') || ',' || lower(p_type)"


@query(f"SELECT p_partkey, list_contains(string_split(replace({_CSV}, ', ', ','), ','), 'widget') AS hit FROM part WHERE list_contains(string_split(replace({_CSV}, ', ', ','), ','), 'widget') OR contains({_CSV}, 'econ')")
def tag_filters(spark, folder):
    """Exact membership in a list of tags, and tags that hold a substring."""
    csv = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(","), F.lower("p_type"))
    exact = T.has_tag(csv, "widget")
    return table(spark, folder, "part").where(exact | F.contains(csv, F.lit("econ"))).select("p_partkey", exact.alias("hit"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 5 < 3 AND o_orderdate <= TIMESTAMP '1998-06-01' - INTERVAL 12 HOUR)""")
def retryable(spark, folder):
    """Open, or failed with attempts left and the cool-down over; now is a parameter."""
    cooled = F.col("o_orderdate") <= F.lit("1998-06-01").cast("timestamp_ntz") - F.expr("INTERVAL 12 HOUR")
    return table(spark, folder, "orders").where((F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 < 3) & cooled)).select("o_orderkey")


@query("SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS complete, count(*) AS n FROM lineitem GROUP BY 1")
def archive_complete(spark, folder):
    """Whether all children are done."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("complete"), F.count(F.lit(1)).alias("n"))


_PHRASE = "CASE page_id % 5 WHEN 0 THEN ' Loading... ' WHEN 1 THEN 'Redirecting to ' || url WHEN 2 THEN 'Sign in or sign up' ELSE html END"


@query(f"SELECT page_id, length(trim(t)) <= 300 AND regexp_matches(lower(trim(t)), 'redirecting|loading\\.\\.\\.|sign in or sign up|<div></div>|coming soon|your profile|manage account|google apps|google drive') AS low FROM (SELECT page_id, {_PHRASE} AS t FROM pages)")
def empty_pages(spark, folder):
    t = F.when(F.col("page_id") % 5 == 0, " Loading... ").when(F.col("page_id") % 5 == 1, F.concat(F.lit("Redirecting to "), F.col("url"))).when(F.col("page_id") % 5 == 2, "Sign in or sign up").otherwise(F.col("html"))
    return table(spark, folder, "pages").select("page_id", T.empty_page(t).alias("low"))


_ERRORS = "[ 'no such host', 'x509: bad', 'status 523', '403 Forbidden', 'unsupported file type', 'request timed out', 'fetch failed', 'status 429', 'connection refused', 'status 503', 'odd' ]"


@query(f"""
WITH e AS (SELECT event_id, user_id % 6 AS failures, ({_ERRORS})[1 + event_id % 11] AS error FROM events),
k AS (SELECT *, ['dns_nxdomain', 'tls_certificate', 'cloudflare_edge', 'http_access_denied', 'unsupported_file', 'timeout', 'fetch_failed', 'rate_limited', 'connectivity', 'http_5xx', 'unknown'][1 + event_id % 11] AS kind FROM e)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE failures > 0 AND failures >= CASE WHEN kind IN ('unknown', 'fetch_failed', 'http_5xx') THEN 4
  WHEN kind IN ('dns_nxdomain', 'unsupported_file') THEN 1 WHEN kind = 'rate_limited' THEN NULL ELSE 2 END) AS final FROM k GROUP BY kind""")
def failure_kinds(spark, folder):
    """Failures by kind and how many had their last attempt."""
    errors = F.array(*(F.lit(e.strip(" '")) for e in _ERRORS.strip("[ ]").split("',")))
    rows = table(spark, folder, "events").select((F.col("user_id") % 6).alias("failures"), F.element_at(errors, (1 + F.col("event_id") % 11).cast("int")).alias("error"))
    rows = rows.withColumn("kind", T.failure_kind(F.col("error")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.final_attempt(F.col("kind"), F.col("failures"))).alias("final"))


@query("SELECT event_id, user_id FROM events WHERE (event_type, user_id, event_id) > ('error', 40, 5000) ORDER BY event_type, user_id, event_id LIMIT 500")
def after_cursor(spark, folder):
    keys = ["event_type", "user_id", "event_id"]
    return table(spark, folder, "events").where(after(keys, ["error", 40, 5000])).orderBy(*keys).limit(500).select("event_id", "user_id")


@query("""
SELECT doc_id, CAST(contains(lower(text), 'that') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) AS n
FROM documents WHERE CAST(contains(lower(text), 'that') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) >= 2""")
def relaxed_filter(spark, folder):
    """At least two of the terms."""
    n = T.matched_terms(F.lower("text"), ["that", "license", "token"])
    return table(spark, folder, "documents").withColumn("n", n).where("n >= 2").select("doc_id", "n")


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part) GROUP BY 1")
def union_all(spark, folder):
    one = lambda name: table(spark, folder, name).select(F.lit(name).alias("kind"))
    return one("customer").unionByName(one("supplier")).unionByName(one("part")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM o INTERSECT SELECT k FROM f) UNION ALL SELECT 'open only', count(*) FROM (SELECT k FROM o EXCEPT SELECT k FROM f)""")
def set_proofs(spark, folder):
    orders = table(spark, folder, "orders")
    opened, done = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "OF")
    counted = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return counted(opened.intersect(done), "both").unionByName(counted(opened.subtract(done), "open only"))


@query("SELECT lower(p_brand) AS k, min_by(p_brand || ':' || p_partkey, p_partkey) AS first FROM part GROUP BY 1")
def folded_unique(spark, folder):
    """The first spelling of each value, by lower case."""
    return table(spark, folder, "part").groupBy(F.lower("p_brand").alias("k")).agg(F.min_by(F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")), "p_partkey").alias("first"))
