"""Streaming forms, sessions, and the research plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import research
from lodestone.plans.terms import terms_of
from lodestone.queries import query
from lodestone.sources.tables import table
from lodestone.streaming import events as S
from lodestone.streaming.projection import Projection


@query("SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_buckets(spark, folder):
    """Six-hour buckets by a stream over the table's files."""
    counted = S.tumbling(S.stream_of(spark, f"{folder}/events.parquet"), "ts", "6 hours", "1 day", "event_type")
    return S.drained(counted).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 21600000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.sessions(rows, "ts", "6 hours", "user_id").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_latest(spark, folder):
    """The newest event of each user, kept up by a stream."""
    return S.latest_by_key(S.stream_of(spark, f"{folder}/events.parquet"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query()
def stream_incidents(spark, folder):
    """Incidents of each user, by a stateful stream."""
    return S.drained(S.incidents(S.stream_of(spark, f"{folder}/events.parquet")), "append")


_QUESTION = "What is licensed under the thing that is not open?"


def _pack_sql(question: str, most: int) -> str:
    lanes = research.variants(question)
    terms, words = sorted({t for lane in lanes for t in lane}), terms_of(question)
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = lambda i: f"greatest(ln((n_docs - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))"
    number = lambda lane: [terms.index(t) for t in lane]
    each = " UNION ALL ".join(f"SELECT {j} AS lane, doc_id, {' + '.join(map(part, number(lane)))} AS score FROM t, s WHERE {' AND '.join(f'tf{i} > 0' for i in number(lane))}" for j, lane in enumerate(lanes))
    ranks = [f"max(rank) FILTER (WHERE lane = {j})" for j in range(len(lanes))]
    order = ", ".join(f"coalesce({r}, 2147483647)" for r in ranks)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), t AS (SELECT doc_id, len(w) AS n, {tf} FROM w), s AS (SELECT count(*) AS n_docs, avg(n) AS mean, {df} FROM t),
l AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, doc_id) AS rank FROM l QUALIFY rank <= 50),
f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score, {', '.join(f'{r} AS lane{j}_rank' for j, r in enumerate(ranks))} FROM r GROUP BY doc_id ORDER BY sum(1.0 / (60 + rank)) DESC, least({order}), {order}, doc_id LIMIT 20),
d AS (SELECT doc_id, x AS text, lower(x) AS low FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM documents JOIN f USING (doc_id))),
p AS (SELECT doc_id, term, length(term) AS m, unnest(string_split(low, term)) AS piece, generate_subscripts(string_split(low, term), 1) AS k FROM d, (VALUES {', '.join(f"('{t}')" for t in words)}) AS v(term)),
h AS (SELECT doc_id, term, m, k, max(k) OVER (PARTITION BY doc_id, term) - 1 AS often, sum(length(piece) + m) OVER (PARTITION BY doc_id, term ORDER BY k) - m AS pos FROM p),
c AS (SELECT DISTINCT doc_id, term, m, often FROM h),
g AS (SELECT DISTINCT h.doc_id, CAST(greatest(least(pos - {most // 4}, length(low) - {most}), 0) AS BIGINT) AS start, h.m, low FROM h JOIN d USING (doc_id) WHERE k <= often),
b AS (SELECT doc_id, arg_min(start, (-score, start)) AS start FROM (SELECT g.doc_id, start, g.m + sum(CASE WHEN contains(substr(low, start + 1, {most}), c.term) THEN 100 + 1000 // greatest(often, 1) + c.m ELSE 0 END) AS score FROM g JOIN c USING (doc_id) GROUP BY g.doc_id, start, g.m, low) GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score, {', '.join(f'lane{j}_rank' for j in range(len(lanes)))}, CASE WHEN start > 0 THEN '...' ELSE '' END || trim(substr(text, start + 1, {most})) || CASE WHEN start + {most} < length(text) THEN '...' ELSE '' END AS excerpt FROM f JOIN d USING (doc_id) JOIN b USING (doc_id)"""


_CASES = [
    {"id": "license", "question": "What is licensed under it?", "expected": [0], "forbidden": []},
    {"id": "words", "question": "thre and ble", "expected": [], "forbidden": [1]},
    {"id": "nothing", "question": "zebracorn", "expected": [], "forbidden": [3]},
]


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), c AS (SELECT * FROM (VALUES ('license', ['licensed', 'under'], [0], []::BIGINT[]), ('words', ['thre', 'ble'], [], [1]), ('nothing', ['zebracorn'], [], [3])) AS v(id, terms, expected, forbidden)),
t AS (SELECT id, doc_id, len(w) AS n, len(terms) AS k, unnest(terms) AS term, w FROM c, w), h AS (SELECT *, len(list_filter(w, lambda x: starts_with(x, term))) AS tf FROM t),
s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM w), df AS (SELECT id, term, count(*) FILTER (WHERE tf > 0) AS df FROM h GROUP BY 1, 2),
b AS (SELECT id, doc_id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM h JOIN df USING (id, term), s GROUP BY id, doc_id, k HAVING count(*) FILTER (WHERE tf > 0) = k),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 10), l AS (SELECT id, list(doc_id ORDER BY rank) AS hits FROM r GROUP BY id)
SELECT id, array_to_string(coalesce(hits, []), ' ') AS hits, list_filter(expected, lambda x: NOT list_contains(coalesce(hits, []), x)) = [] AND list_filter(forbidden, lambda x: list_contains(coalesce(hits, []), x)) = [] AS passes FROM c LEFT JOIN l USING (id)""")
def question_checks(spark, folder):
    """Questions with expected and forbidden documents, all scored in one scan."""
    found = research.checked(table(spark, folder, "documents"), "doc_id", "text", _CASES)
    return found.select("id", F.array_join("hits", " ").alias("hits"), "passes")


@query(_pack_sql(_QUESTION, 240))
def research_pack(spark, folder):
    """Evidence for a question, fused from the lanes of its variants."""
    found = research.evidence_pack(table(spark, folder, "documents"), "doc_id", "text", _QUESTION)
    ranks = [F.col(c).cast("long").alias(c) for c in found.columns if c.endswith("_rank")]
    return found.select("doc_id", F.round("score", 9).alias("score"), *ranks, "excerpt")


@query("""
WITH r AS (SELECT doc_id, doc_id % 4 AS revision, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, revision, substr(text, 500 * i + 1, 500) AS t FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM r WHERE revision <= 2))
SELECT doc_id, revision, 'projected' AS state, coalesce(n, 0) AS chunks, coalesce(longest, 0) AS longest FROM r LEFT JOIN (SELECT doc_id, count(*) AS n, max(length(t)) AS longest FROM c GROUP BY 1) USING (doc_id) WHERE revision <= 2
UNION ALL SELECT doc_id, revision, 'dirty', 0, 0 FROM r WHERE revision > 2""")
def watermark_projection(spark, folder):
    """Documents as changes of revisions 0 to 3, projected up to 2 in two runs; those of revision 3 stay dirty."""
    log = S.stream_of(spark, f"{folder}/documents.parquet").select("doc_id", (F.col("doc_id") % 4).alias("revision"), "text")

    def cut(rows):
        size = F.length(F.coalesce("text", F.lit("")))
        places = F.when(size > 0, F.sequence(F.lit(0), F.ceil(size / 500).cast("int") - 1))
        return rows.select("doc_id", "revision", "text", F.explode(places).alias("i")).select("doc_id", "revision", "i", F.substring(F.col("text"), F.col("i") * 500 + 1, F.lit(500)).alias("piece"))

    held = Projection(spark, S.folder_for(spark, "projection"), log.schema, cut, "doc_id")
    for upto in (1, 2):
        held.run(log, upto)
    sizes = held.chunks(F.length("piece").alias("size")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    done = held.projected().join(sizes, "doc_id", "left").select("doc_id", "revision", F.lit("projected").alias("state"), zero("n").alias("chunks"), zero("most").alias("longest"))
    none = F.lit(0).cast("long")
    return done.unionByName(held.dirty().select("doc_id", "revision", F.lit("dirty").alias("state"), none.alias("chunks"), none.alias("longest")))
