"""The queries of this package: thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import conversations, decontam, infilling, lengths, lines, lmscore, packing, pii, quality, rules, simhash, substring, tokens
from lodestone.llm.common import documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet matrices and read back."""
    found = tokens.token_files(documents(spark, sf_dir))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    found = packing.pack(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "size_class")


@query
def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    spans = pii.find_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE]
    return spans.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"))


@query
def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labelled rows outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that an earlier document has."""
    found = substring.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that two bits or fewer connect."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by words and by all segmentations into subwords."""
    return lmscore.log_likelihood(documents(spark, sf_dir))


@query
def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    found = decontam.phrase_matches(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    out = found.select("doc_id", decontam.count_words(F.col("words")).alias("n_words"), decontam.covered(F.col("hits")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op9_positional_index"] = f"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k),
hit AS (
  SELECT DISTINCT doc_id, i, spot.k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM spot) AS spot JOIN win ON spot.s = win.s AND spot.k = win.k
),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the verdict on all documents."""
    found = rules.judge(documents(spark, sf_dir).select("doc_id", "text"), drop=("text",))
    s, r = F.col("rules.s"), F.col("rules")
    return found.select("doc_id", s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"), r["base_failed"].alias("base_failed"), r["kept"].alias("kept"), r["posterior"].alias("posterior"))


@query
def op5_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier line equals or nearly equals; classes has line:doc_id:line of each and of the line that stands for it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = lines.by_document(docs).withColumnRenamed("doc_id", "id")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    number = lambda r: r["no"].cast("string")
    head = lambda r: F.concat_ws(":", number(r), r["head"]["doc_id"].cast("string"), r["head"]["no"].cast("string"))
    listed = lambda f: F.concat_ws(",", F.transform("removed", f))
    return out.select("doc_id", zero("n_lines"), zero("n_removed"), zero("n_near"), listed(number).alias("removed"), listed(head).alias("classes"))


@query
def op11_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of all conversations, damaged as the contract says and repaired."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, _ = conversations.repair(conversations.damaged(table))
    return conversations.with_all(found, table)


@query
def op12_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return lengths.token_counts(documents(spark, sf_dir))


@query
def op13_automaton_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for infilling, and back."""
    found = infilling.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim.*")
    back = F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), back)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


ORACLES["op2_level_doubling"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS low FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN f USING (h) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS s FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Lines by what one character less leaves of them; a place is doc_id and line number in one number.
ORACLES["op5_segment_join"] = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, no, line, doc_id * 1000000 + no AS place FROM
  (SELECT doc_id, unnest(range(len(parts))) AS no, trim(unnest(parts), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM s) WHERE line <> ''),
f AS (SELECT line, min(place) AS first FROM l GROUP BY line),
long AS (SELECT * FROM f WHERE length(line) >= 20),
r AS (SELECT line, first, length(line) AS n, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS rest FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM long)),
same AS (SELECT n, i, rest, min(first) AS head FROM r GROUP BY n, i, rest HAVING count(*) > 1),
grown AS (SELECT DISTINCT r.line AS more, r.first AS a, c.line AS less, c.first AS b FROM r JOIN long AS c ON r.rest = md5(c.line)),
late AS (SELECT line, head AS earlier FROM r JOIN same USING (n, i, rest) WHERE first > head UNION ALL SELECT more, b FROM grown WHERE a > b UNION ALL SELECT less, a FROM grown WHERE a < b),
k AS (SELECT line, min(earlier) AS earlier FROM late GROUP BY line),
x AS (SELECT doc_id, no, place <> first AS equal, earlier IS NOT NULL AS alike, least(first, coalesce(earlier, first)) AS head FROM l JOIN f USING (line) LEFT JOIN k USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE equal OR alike) AS n_removed, count(*) FILTER (WHERE alike AND NOT equal) AS n_near,
  string_agg(no, ',' ORDER BY no) FILTER (WHERE equal OR alike) AS removed, string_agg(no || ':' || (head // 1000000) || ':' || (head % 1000000), ',' ORDER BY no) FILTER (WHERE equal OR alike) AS classes FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed, coalesce(classes, '') AS classes
FROM documents LEFT JOIN g USING (doc_id)
"""

#: crc32 bit by bit; the cheapest edits by recursion from the last row of each conversation, a cost and the edits for each of the four states.
ORACLES["op11_signature_repair"] = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS head,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || head NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (
  SELECT conv_id, n AS i, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS b FROM s
  UNION ALL
  SELECT conv_id, i, [list_min([w[1], {'c': w[3].c + 2, 'a': 'I' || w[3].a}, {'c': w[4].c + 4, 'a': 'II' || w[4].a}]), list_min([w[2], {'c': w[3].c + 2, 'a': 'I' || w[3].a}, {'c': w[4].c + 4, 'a': 'II' || w[4].a}]),
    list_min([w[3], {'c': w[4].c + 2, 'a': 'I' || w[4].a}]), list_min([w[4], {'c': w[3].c + 2, 'a': 'I' || w[3].a}])] AS b
  FROM (SELECT v.conv_id, v.i - 1 AS i, list_transform([1, 2, 3, 4], lambda q: list_min([{'c': b[q].c + 3, 'a': 'D' || b[q].a},
      {'c': b[CASE q WHEN 3 THEN 4 ELSE 3 END].c + CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'a': 'R' || b[CASE q WHEN 3 THEN 4 ELSE 3 END].a},
      CASE WHEN q = 1 AND head = 's' THEN {'c': b[2].c + CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'a': 'K' || b[2].a}
           WHEN q <> 3 AND head = 'u' OR q = 3 AND head = 'a' THEN {'c': b[CASE q WHEN 3 THEN 4 ELSE 3 END].c + CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'a': 'K' || b[CASE q WHEN 3 THEN 4 ELSE 3 END].a}
           ELSE {'c': 1000000000, 'a': ''} END])) AS w
    FROM v JOIN r ON r.conv_id = v.conv_id AND r.i = v.i)),
best AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS j, length(replace(audit, 'D', '')) % 2 AS odd FROM best WHERE audit <> ''),
p AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS nth FROM e),
t AS (SELECT p.conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (nth + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.i = p.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY p.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN t USING (conv_id)
"""

ORACLES["op13_automaton_infilling"] = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
g AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || x[17:24] AS BIGINT) AS c, CAST('0x' || x[25:32] AS BIGINT) AS d FROM h),
f AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c % 100 >= 90 THEN 'plain' WHEN d % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(text, 1, low) AS prefix, substring(text, low + 1, high - low) AS middle, substring(text, high + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
