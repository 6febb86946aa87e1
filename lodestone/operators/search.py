"""Ranked text search: analyser, postings, BM25, the staged cascade.

The analyser lowers text and takes runs of letters and digits; it does not stem. A query term matches all tokens that
begin with it. One scan computes every stage for an ad-hoc query; `postings` stores an index for repeated ones, which then reads only
the rows of the query's terms.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Terms of a query: split at white space, trimmed to letters and digits, lowered, each once."""
    found = (re.sub(r"^[^\w]+|[^\w]+$", "", t).lower() for t in query.split())
    return list(dict.fromkeys(t for t in found if t))


def relaxed_terms(query: str) -> list[str]:
    """Terms of three bytes or more; hyphens stay."""
    found = (re.sub(r"^[^\w-]+|[^\w-]+$", "", t).lower() for t in query.split())
    return list(dict.fromkeys(t for t in found if len(t.encode()) >= 3))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: F.startswith(w, F.lit(term))))


def _hit(text: str, terms: list[str]) -> Column:
    """(n_tokens, tf: array for the terms) of a text, its words taken once."""
    return F.transform(F.array(tokens(F.col(text))), lambda w: F.struct(F.size(w).alias("n_tokens"), F.array(*(_count(w, t) for t in terms)).cast("array<int>").alias("tf")))[0]


def _statistics(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """One row: N, mean length and, for each term, the documents that have it."""
    hits = docs.select(_hit(text, terms).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("N"), F.avg("hit.n_tokens").alias("mean"), *(F.count_if(F.col("hit.tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))


def _bm25(terms: list[str], of: list[int] | None = None) -> Column:
    """The score by all terms, or by those of some numbers."""

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col("tf")[i]
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))

    return reduce(lambda a, b: a + b, (part(i) for i in (range(len(terms)) if of is None else of)), F.lit(0.0))


def ranked_lanes(docs: DataFrame, key: str, text: str, lanes: dict[str, list[str]], depth: int) -> DataFrame:
    """(lane, key, score, rank): for each lane the best `depth` documents that have all its terms, by BM25 and then by key. One scan scores all lanes, one gives a row of statistics; a lane without terms finds nothing."""
    terms = sorted({t for lane in lanes.values() for t in lane})
    number = {t: i for i, t in enumerate(terms)}
    of = {name: [number[t] for t in dict.fromkeys(lane)] for name, lane in lanes.items()}
    some = F.explode_outer(F.filter(F.array(_hit(text, terms)), lambda h: F.exists(h["tf"], lambda x: x > 0))).alias("hit")
    base = docs.select(key, some).where("hit is not null").select(key, "hit.n_tokens", "hit.tf").crossJoin(F.broadcast(_statistics(docs, text, terms)))  # a row
    has = {name: reduce(lambda a, b: a & b, (F.col("tf")[i] > 0 for i in of[name]), F.lit(bool(of[name]))) for name in lanes}
    each = F.filter(F.array(*(F.when(has[name], F.struct(F.lit(name).alias("lane"), _bm25(terms, of[name]).alias("score"))) for name in lanes)), lambda x: x.isNotNull())
    found = base.select(key, F.inline(each))
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("score"), F.asc(key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= depth).select("lane", key, "score", "rank")


def scored(docs: DataFrame, key: str, text: str, terms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, n_tokens, tf: array for the terms, score): BM25 over all documents with any of the terms; one scan and one row of statistics.

    The outer explode keeps the filter above the words, so that they are taken once for each text.
    """
    some = F.explode_outer(F.filter(F.array(_hit(text, terms)), lambda h: F.exists(h["tf"], lambda x: x > 0))).alias("hit")
    base = docs.select(key, *keep, some).where("hit is not null").select(key, *keep, "hit.n_tokens", "hit.tf")
    return base.crossJoin(F.broadcast(_statistics(docs, text, terms))).select(key, *keep, "n_tokens", "tf", _bm25(terms).alias("score"))


def tokenised(docs: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """(key, n_tokens, words): the words of each text, taken once; with terms, only those words that begin with one of them. All rows stay, for counts and means."""
    wanted = lambda w: F.filter(w, lambda x: reduce(lambda a, b: a | b, (F.startswith(x, F.lit(t)) for t in terms))) if terms else w
    both = F.transform(F.array(tokens(F.col(text))), lambda w: F.struct(F.size(w).alias("n_tokens"), wanted(w).alias("words")))
    return docs.select(key, F.inline(both))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, n_tokens), an index to be written sorted by term; counts combine within documents before the shuffle."""
    return posted(tokenised(docs, key, text), key)


def posted(held: DataFrame, key: str) -> DataFrame:
    """The postings of `tokenised` texts."""
    return held.select(key, "n_tokens", F.explode("words").alias("term")).groupBy("term", key, "n_tokens").agg(F.count(F.lit(1)).alias("tf"))


def search_postings(index: DataFrame, key: str, terms: list[str], total: int, mean: float) -> DataFrame:
    """(key, score) of documents that have all the terms, from the index; only the terms' own rows are read."""
    hit = reduce(lambda a, b: a | b, (F.startswith("term", F.lit(t)) for t in terms))
    which = F.explode(F.filter(F.array(*(F.when(F.startswith("term", F.lit(t)), F.lit(i)) for i, t in enumerate(terms))), lambda x: x.isNotNull())).alias("i")
    rows = index.where(hit).select(key, "n_tokens", "tf", which).groupBy(key, "n_tokens", "i").agg(F.sum("tf").alias("tf"))
    df = rows.groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / mean))
    return rows.join(F.broadcast(df), "i").groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms")).where(F.col("terms") == len(terms)).select(key, "score")


def cascade(docs: DataFrame, key: str, text: str, query: str, recency: str, limit: int = 10) -> DataFrame:
    """(key, stage, score), at most `limit` rows: exact key, else all terms, else substring, else two or more terms.

    Exact and ranked rows go together; the later stages count only where nothing came before. One scan finds the stages of each row,
    and tasks keep the best `limit` rows of each stage before the shuffle, so that the last step sees a handful.
    """
    terms, loose = query_terms(query), relaxed_terms(query)
    low = F.lower(text)
    some = reduce(lambda a, b: a + b, (F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in loose), F.lit(0))

    def stages(h: Column) -> Column:
        full = F.exists(h["tf"], lambda x: x > 0) & F.forall(h["tf"], lambda x: x > 0)
        each = (h["exact"], full, h["like"], h["some"] >= min(2, len(loose)))
        return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(each, 1))), lambda x: x.isNotNull())

    exact, like = F.col(key).cast("string") == query, F.contains(low, F.lit(query.lower()))
    row = F.transform(F.array(_hit(text, terms)), lambda h: F.struct(h["n_tokens"].alias("n_tokens"), h["tf"].alias("tf"), exact.alias("exact"), like.alias("like"), some.alias("some")))
    each = F.explode_outer(F.flatten(F.transform(row, lambda h: F.transform(stages(h), lambda i: F.struct(i.alias("stage"), h["n_tokens"].alias("n_tokens"), h["tf"].alias("tf"), h["some"].alias("some")))))).alias("h")
    found = docs.select(key, recency, each).where("h is not null").select(key, recency, "h.*").crossJoin(F.broadcast(_statistics(docs, text, terms)))
    score = F.when(F.col("stage") == 2, _bm25(terms)).when(F.col("stage") == 4, F.col("some").cast("double")).otherwise(0.0)
    best = [F.desc("score"), F.desc(recency), F.asc(key)]
    top = found.select(key, recency, "stage", score.alias("score")).withColumn("_n", F.row_number().over(Window.partitionBy("stage").orderBy(*best))).where(F.col("_n") <= limit)
    group = F.greatest(F.col("stage"), F.lit(2))  # from here on four times `limit` rows at most
    kept = top.withColumn("_first", F.min(group).over(Window.partitionBy(F.lit(0)))).where(group == F.col("_first"))
    once = kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("stage"))).where("_r = 1")
    return once.orderBy("stage", *best).limit(limit).select(key, "stage", "score")


def term_score(title: Column, tags: Column, body: Column, terms: list[str], phrase: str) -> Column:
    """Additive score: for each term the first field that has it (title 12, tags 10, body 4), phrases 15 and 12, all of several terms 12, each missing one of three or more -8."""
    hit = [F.when(F.contains(title, F.lit(t)), 12).when(F.contains(tags, F.lit(t)), 10).when(F.contains(body, F.lit(t)), 4).otherwise(0) for t in terms]
    total = reduce(lambda a, b: a + b, hit)
    missing = reduce(lambda a, b: a + b, (F.when(h == 0, 1).otherwise(0) for h in hit))
    total = total + F.when(F.contains(title, F.lit(phrase)), 15).otherwise(0) + F.when(F.contains(tags, F.lit(phrase)), 12).otherwise(0)
    if len(terms) > 1:
        total = total + F.when(missing == 0, 12).otherwise(0)
    if len(terms) >= 3:
        total = total - 8 * missing
    return total
