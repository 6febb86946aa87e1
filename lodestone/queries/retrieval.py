"""Evidence projection, strategy scores, entity boosts, pools, sections, index upkeep and derived entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import markup as M
from lodestone.functions.text import EMPTY_PAGE_PHRASES
from lodestone.operators import evidence as E
from lodestone.operators import retrieval as R
from lodestone.operators import search
from lodestone.queries import query
from lodestone.sources.tables import table

_FIRST = "CASE WHEN contains(title, '{t}') THEN 12 WHEN contains(tags, '{t}') THEN 10 WHEN contains(summary, '{t}') THEN 8 WHEN contains(author, '{t}') THEN 6 WHEN contains(url, '{t}') THEN 2 WHEN contains(body, '{t}') THEN 4 ELSE 0 END"
_TERMS = ("licensed", "que", "doc")


@query(f"""
WITH f AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(lang) AS tags, CASE WHEN doc_id % 3 = 0 THEN lower(substr(text, 1, 80)) ELSE '' END AS summary, lower(source) AS author, 'https://example.org/doc/' || doc_id AS url, lower(text) AS body, doc_id FROM documents),
s AS (SELECT *, {_FIRST.format(t=_TERMS[0])} AS a, {_FIRST.format(t=_TERMS[1])} AS b, {_FIRST.format(t=_TERMS[2])} AS c FROM f)
SELECT doc_id, a + b + c + least(doc_id % 5 * 3, 9) + CAST(doc_id % 2 = 0 AS INT) + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN trim(summary) <> '' THEN 3 ELSE 0 END
 + CASE WHEN a > 0 AND b > 0 AND c > 0 THEN 12 ELSE 0 END - 8 * (CAST(a = 0 AS INT) + CAST(b = 0 AS INT) + CAST(c = 0 AS INT)) AS score FROM s""")
def evidence_fields(spark, folder):
    """The score over all fields, whole texts as the last one."""
    every = lambda n: F.col("doc_id") % n == 0
    fields = {
        "title": F.split_part("text", F.lit("\n"), F.lit(1)), "tags": F.col("lang"), "summary": F.when(every(3), F.substring("text", 1, 80)),
        "author": F.col("source"), "url": F.concat(F.lit("https://example.org/doc/"), F.col("doc_id")), "full_text": F.col("text"),
    }
    score = R.field_score(fields, list(_TERMS), every(2), every(7), "which repo has licensed que doc", F.col("doc_id") % 5)
    return table(spark, folder, "documents").select("doc_id", score.alias("score"))


@query("""
WITH h AS (SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z0-9])(der|die)([^a-z0-9]|$)') AS a, regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') AS b, contains(lower(text), 'the th') AS c FROM conversations)
SELECT conv_id, turn, CAST(10 + greatest(8 - turn, 0) + 14 * (CAST(a AS INT) + CAST(b AS INT)) + 4 * CAST(c AS INT) - 12 * (2 - CAST(a AS INT) - CAST(b AS INT)) + CASE WHEN a AND b THEN 24 ELSE 0 END AS BIGINT) AS score FROM h""")
def strategy_scores(spark, folder):
    """Scores moved by rank and by required and optional concepts."""
    hits = R.concept_hits(F.col("text"), {"german": ["der", "die"], "french": ["que"], "english": ["the th"]})
    score = R.strategy_score(F.lit(10), F.col("turn"), hits, ["german", "french"])
    return table(spark, folder, "conversations").select("conv_id", "turn", score.cast("long").alias("score"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(der|die)([^a-z0-9]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9])sch([^a-z0-9]|$)')")
def required_concepts(spark, folder):
    return R.with_required(table(spark, folder, "conversations"), "text", {"german": ["der", "die"], "sch": ["sch"]}).select("conv_id", "turn")


_SCORE = "CASE WHEN n = '{q}' OR k = '{q}' THEN 10 WHEN contains(n, '{q}') OR contains(k, '{q}') THEN {w} ELSE 0 END"
_QUERIES = (("big red rings", 8, 6), ("red ring", 6, 6), ("red", 3, 4), ("ring", 3, 4))
_BOOST = f"""e AS (SELECT p_partkey, p_name, lower(p_name) AS n, lower(p_type) AS k, p_size % 5 AS refs FROM part),
x AS (SELECT *, {' + '.join(f"CASE WHEN {_SCORE.format(q=q, w=i)} > 0 THEN {_SCORE.format(q=q, w=i)} + {w} + least(refs, 3) ELSE 0 END" for q, w, i in _QUERIES)} AS score FROM e WHERE contains(n, 'red ring') OR contains(k, 'red ring') OR ((contains(n, 'red') OR contains(k, 'red')) AND (contains(n, 'ring') OR contains(k, 'ring')))),
b AS (SELECT p_partkey, p_name, least(score, 8) AS boost FROM x WHERE score > 0 ORDER BY score DESC, refs DESC, n, p_partkey LIMIT 40),
g AS (SELECT l_orderkey AS ref, sum(boost) AS boost, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS entities FROM b JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1)"""


def _boosts(spark, folder):
    part = table(spark, folder, "part")
    entities = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("refs"), F.array(F.lower("p_name"), F.lower("p_type")).alias("candidates"))
    references = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("ref")).distinct()
    return R.entity_boosts(entities, references, "big red rings", ["red", "ring"], E.text_score, 40)


@query(f"WITH {_BOOST} SELECT ref, CAST(boost AS BIGINT) AS boost, entities FROM g")
def entity_boosts(spark, folder):
    """Orders that the best entities for a question refer to."""
    return _boosts(spark, folder).select("ref", "boost", F.array_join("entities", ",").alias("entities"))


@query(f"WITH {_BOOST} SELECT ref FROM g WHERE ref NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def entity_expansion(spark, folder):
    """Of those, the orders that no other lane has found."""
    seen = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return R.expanded(_boosts(spark, folder), seen).select("ref")


@query("""
WITH l AS (SELECT doc_id AS key, 0 AS i, 'text' AS lane FROM documents WHERE contains(lower(text), 'licensed') UNION ALL SELECT doc_id, 1, 'tag' FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 2, 'source' FROM documents WHERE n_chars > 2000)
SELECT key, string_agg(lane, '+' ORDER BY i) AS lanes FROM l GROUP BY 1""")
def candidate_pool(spark, folder):
    """Lanes pooled: each key once, with where it came from."""
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "key")
    lanes = {"text": docs.where(F.contains(F.lower("text"), F.lit("licensed"))), "tag": docs.where("lang = 'fr'"), "source": docs.where("n_chars > 2000")}
    return R.pooled(lanes).select("key", F.array_join("lanes", "+").alias("lanes"))


@query("""
WITH p AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15),
r AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) SELECT key, 'primary' AS role FROM p UNION ALL SELECT key, 'related' FROM r""")
def primary_related(spark, folder):
    """Twenty results, five of them kept for related ones."""
    found = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "P").alias("is_related"), "o_totalprice")
    return R.primary_and_related(found, 20, 5, [F.desc("o_totalprice"), F.asc("key")])


@query("""
WITH p AS (SELECT doc_id, list_filter([{'role': 'title', 'text': trim(split_part(text, chr(10), 1))}, {'role': 'body', 'text': trim(text)}, {'role': 'note', 'text': CASE WHEN doc_id % 2 = 0 THEN trim(lang) ELSE '' END}], lambda s: s.text <> '') AS s FROM documents),
q AS (SELECT doc_id, list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: y.text), x.text) = i) AS s FROM p)
SELECT doc_id, i - 1 AS ordinal, s[i].role AS role, md5(s[i].text) AS digest FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM q)""")
def content_sections(spark, folder):
    """Sections of items, each text once."""
    parts = {"title": F.split_part("text", F.lit("\n"), F.lit(1)), "body": F.col("text"), "note": F.when(F.col("doc_id") % 2 == 0, F.col("lang"))}
    found = R.sections(table(spark, folder, "documents"), ["doc_id"], parts)
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "role", F.md5("text").alias("digest"))


_POSTED = r"""(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS term FROM ({rows})) GROUP BY 1, 2)"""
_OLD, _NEW = "SELECT doc_id, lang || ' ' || source AS t FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 1 AND doc_id % 10 <> 2", "SELECT doc_id, source || chr(10) || chr(10) || 'tag' || doc_id % 3 AS t FROM documents WHERE doc_id % 10 = 1"


@query(f"SELECT * FROM {_POSTED.format(rows=_OLD)} UNION ALL SELECT * FROM {_POSTED.format(rows=_NEW)}")
def index_upkeep(spark, folder):
    """Postings after some documents have changed and others have gone."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    posted = lambda df, text: search.postings(df.withColumn("t", text), "doc_id", "t").select("doc_id", "term", "tf")
    index = posted(docs.where("doc_id % 4 <> 0"), F.concat("lang", F.lit(" "), "source"))
    new = posted(docs.where("doc_id % 10 = 1"), R.index_text(F.col("source"), F.lit(" "), F.concat(F.lit("tag"), F.col("doc_id") % 3)))
    return R.refreshed(index, new, docs.where("doc_id % 10 in (1, 2)"), "doc_id")


@query("""
WITH n AS (SELECT conv_id, turn, turn % 2 AS role FROM conversations WHERE conv_id % 3 = 0 AND turn > 1)
SELECT conv_id, turn, CAST(2 AS BIGINT) AS role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT * FROM n""")
def child_links(spark, folder):
    """The links of some parents replaced as a whole; parents without new ones lose theirs."""
    rows = table(spark, folder, "conversations")
    old = rows.select("conv_id", "turn", F.lit(2).cast("long").alias("role"))
    return R.refreshed(old, rows.where("conv_id % 3 = 0 and turn > 1").select("conv_id", "turn", (F.col("turn") % 2).alias("role")), rows.where("conv_id % 3 = 0"), "conv_id")


@query(f"""
SELECT doc_id, s <> 'new' AND (e = 'empty' OR (w AND length(trim(t)) < 500) OR (length(trim(t)) <= 300 AND ({' OR '.join(f"contains(lower(trim(t)), '{p}')" for p in EMPTY_PAGE_PHRASES)}))) AS poor
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'ok' END AS s, CASE WHEN doc_id % 11 = 0 THEN 'empty' ELSE 'ok' END AS e, doc_id % 7 = 0 AS w, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 200) || ' Loading...' END AS t FROM documents)""")
def poor_summaries(spark, folder):
    """Summaries of pages that were no articles."""
    either = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    extract = either(2, F.col("text"), F.concat(F.substring("text", 1, 200), F.lit(" Loading...")))
    poor = R.poor_summary(either(11, "empty", "ok"), either(5, "new", "ok"), either(7, "wayback", "web"), extract)
    return table(spark, folder, "documents").select("doc_id", poor.alias("poor"))


@query("""
WITH m AS (SELECT l_orderkey AS k, bool_or(l_linenumber % 3 = 0) AS photo, bool_or(l_linenumber % 3 = 1) AS video FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber % 5 <> 0 GROUP BY 1),
o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'error' ELSE 'ok' END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS done, o_orderkey % 6 = 0 AS has FROM orders)
SELECT k, coalesce(video, false) AND NOT has AND (status = '' OR (status = 'error' AND done <= '1996-01-01T00:00:00Z')) AS transcribe, coalesce(photo, false) AND status IN ('', 'error') AS read FROM o LEFT JOIN m USING (k)""")
def media_work(spark, folder):
    """Items whose media are to be transcribed or read."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.element_at(F.array(*map(F.lit, ("photo", "video", "other"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("media_type"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("downloaded").alias("download_status"), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise("a").alias("local_path"), F.lit("").alias("pruned_at"))
    status = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", "error").otherwise("ok")
    items = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("done"), F.when(F.col("o_orderkey") % 6 == 0, "said").otherwise("").alias("text"))
    held = items.join(R.media_flags(lines, "k"), "k", "left")
    return held.select("k", R.transcription_due(F.col("kinds"), F.col("text"), F.col("status"), F.col("done"), "1996-01-01T00:00:00Z").alias("transcribe"), R.ocr_due(F.col("kinds"), F.col("status")).alias("read"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2, 3) AND vec_id % 4 IN (0, 1)")
def vector_filters(spark, folder):
    """Vectors whose columns are in allow-lists; an empty list allows all."""
    rows = table(spark, folder, "embeddings").withColumn("kind", F.col("vec_id") % 4)
    return R.allowed(rows, {"label": [1, 2, 3], "kind": [0, 1], "vec_id": []}).select("vec_id")


@query(r"""
WITH w AS (SELECT conv_id, turn, string_split('kids models ' || (conv_id * 12345678) || ' deadbeef' || turn || '0 ' || role, ' ') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9]{8,}|[0-9a-f]{10,}')), lambda x: CASE x WHEN 'kids' THEN 'children' WHEN 'models' THEN 'model' ELSE x END), ' ') AS terms FROM w""")
def folded_terms(spark, folder):
    text = F.concat(F.lit("kids models "), F.col("conv_id") * 12345678, F.lit(" deadbeef"), F.col("turn"), F.lit("0 "), F.col("role"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(R.canonical_terms(F.split(text, " ")), " ").alias("terms"))


@query("""
WITH r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'Seg' ELSE 'seg' END || c_nationkey END AS h, c_mktsegment AS n FROM customer),
k AS (SELECT CASE WHEN h <> '' THEN 'author:' || lower(h) ELSE 'author:name:' || lower(n) END AS entity_key, h, n FROM r),
a AS (SELECT entity_key, unnest(CASE WHEN h = '' THEN [n] ELSE [n, h, lower(h), '@' || h, '@' || lower(h)] END) AS alias FROM k)
SELECT entity_key, name, aliases, refs FROM (SELECT entity_key, min(n) AS name, count(*) AS refs FROM k GROUP BY 1) JOIN (SELECT entity_key, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM a GROUP BY 1) USING (entity_key)""")
def author_entities(spark, folder):
    """Authors from handles and names, with their spellings."""
    handle = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.when(F.col("c_custkey") % 2 == 0, "Seg").otherwise("seg"), F.col("c_nationkey")))
    found = R.author_entities(table(spark, folder, "customer").withColumn("handle", handle), "handle", "c_mktsegment")
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query(r"""
WITH u AS (SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host, string_split(regexp_extract(lower(url), '^[a-z]+://[^/?#]+/([^?#]+)', 1), '/') AS p FROM pages),
e AS (SELECT unnest(CASE WHEN host = 'ththre.example.com' AND coalesce(p[1], '') <> '' AND coalesce(p[2], '') <> '' THEN [{'k': 'owner:' || p[1], 'kind': 'owner'}, {'k': 'repo:' || p[1] || '/' || p[2], 'kind': 'repo'}] WHEN host <> '' THEN [{'k': 'site:' || host, 'kind': 'site'}] ELSE [] END) AS e FROM u)
SELECT e.k AS entity_key, e.kind AS kind, count(*) AS refs FROM e GROUP BY 1, 2""")
def site_entities(spark, folder):
    """Owners, repositories and sites from addresses."""
    return R.site_entities(table(spark, folder, "pages"), "url", "ththre.example.com")


@query("""
WITH t AS (SELECT p_brand AS token, count(*) AS n FROM part GROUP BY 1), m AS (SELECT 'Brand#1' AS old, 'Brand#2' AS new), p AS (SELECT token AS old, unnest(['Brand#1', 'Brand#2', 'Brand#7', 'Brand#12', 'none']) AS new FROM t),
q AS (SELECT p.old, coalesce(m.new, p.new) AS new FROM p LEFT JOIN m ON m.old = p.new WHERE p.old <> 'Brand#1')
SELECT DISTINCT q.old, q.new FROM q JOIN t a ON a.token = q.old JOIN t b ON b.token = q.new WHERE q.old <> q.new AND b.n >= a.n AND right(q.old, 1) <> right(q.new, 1)""")
def kept_aliases(spark, folder):
    """Proposed aliases of brands that pass all rules."""
    tokens = table(spark, folder, "part").groupBy(F.col("p_brand").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    mapped = spark.createDataFrame([("Brand#1", "Brand#2")], "old string, new string")
    proposed = tokens.select(F.col("token").alias("old"), F.explode(F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#7", "Brand#12", "none")))).alias("new"))
    return R.kept_aliases(proposed, tokens, mapped, lambda a, b: F.right(a, F.lit(1)) != F.right(b, F.lit(1))).distinct()


@query(r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark, folder):
    """The text of web pages."""
    return table(spark, folder, "pages").select("page_id", F.md5(R.html_text(F.col("html"))).alias("digest"))


_MARKDOWN = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<head.*?</head>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<a href="([^"]*)">(.*?)</a>', '[\2](\1)', 'g'), '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?h1>', chr(10) || chr(10), 'g'),
 '<li>', chr(10) || '- ', 'g'), '<br>', chr(10), 'g'), '</?(p|div|article|nav|ul|footer|body|html)( [^>]*)?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM b),
m AS (SELECT page_id, trim(trim(regexp_replace(regexp_replace(regexp_replace(h, ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), ' ') AS md FROM c)"""


@query(_MARKDOWN + " SELECT page_id, md FROM m")
def page_markdown(spark, folder):
    """Web pages as Markdown."""
    return table(spark, folder, "pages").select("page_id", M.markdown(F.col("html")).alias("md"))


@query(_MARKDOWN + r""", l AS (SELECT page_id, list_transform(regexp_extract_all(md, '\]\(([^()]*)\)', 1), lambda x: ltrim(x, '/')) AS t FROM m),
k AS (SELECT DISTINCT 'note' || page_id AS name FROM pages), f AS (SELECT page_id, unnest(t) AS target FROM l)
SELECT page_id, count(*) AS links, string_agg(DISTINCT target, ' ' ORDER BY target) AS targets, count(*) FILTER (WHERE target NOT IN (SELECT name FROM k)) AS broken FROM f GROUP BY 1""")
def markdown_links(spark, folder):
    """Links of Markdown files, resolved against the file they stand in, and how many lead to no file."""
    pages = table(spark, folder, "pages").select("page_id", M.markdown(F.col("html")).alias("md"), F.concat(F.lit("note"), "page_id").alias("path"))
    found = pages.select("page_id", "path", F.explode(M.destinations(F.col("md"))).alias("d")).where(~M.external(F.col("d"))).select("page_id", M.resolved(F.col("path"), F.col("d")).alias("target"))
    known = pages.select(F.col("path").alias("target"), F.lit(1).alias("known"))
    each = found.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n")).join(known, "target", "left")
    return each.groupBy("page_id").agg(F.sum("n").alias("links"), F.array_join(F.array_sort(F.collect_set("target")), " ").alias("targets"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("broken"))


@query(r"""
WITH w AS (SELECT page_id, regexp_extract_all(lower(html), '[\p{L}\p{N}]+') AS w FROM pages), t AS (SELECT page_id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'article'))) AS tf FROM w), s AS (SELECT count(*) AS n_docs, avg(n) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM t)
SELECT page_id, round(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 9) AS score FROM t, s WHERE tf > 0""")
def source_search(spark, folder):
    """Sources alone, by BM25; all hits."""
    return search.scored(table(spark, folder, "pages"), "page_id", "html", ["article"]).select("page_id", F.round("score", 9).alias("score"))
