"""Benchmark passages in documents, by a positional inverted index.

A test item is cut into windows of ten consecutive words (shorter items are one window). Term counts over the whole corpus
name the two rarest terms of each window. The index stores postings (term, doc_id, pos) of those terms, for all documents. A
posting less its term's place in an item is an offset; postings of one item, document and offset are intersected, and windows
whose rare terms all are there are compared word for word with the document. DataFrame and SQL functions only.

Null and empty texts have no words and no hits. Items without words have no windows. Null doc_ids and item_ids count as ids of their own
(item_id as the text "null"); rows that share a doc_id are each judged by their own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, materialise, small

#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered; before that A-Z belong to them too.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def lowered(word: Column) -> Column:
    """A-Z lowered and nothing else; lower() alone does that for ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def count_words(words: Column) -> Column:
    empty = lambda i: F.when(F.element_at(words, i) == "", 1).otherwise(0)
    return F.when(F.size(words) == 1, 1 - empty(1)).otherwise(F.size(words) - empty(1) - empty(-1)).cast("long")


def windows(items: DataFrame, length: int) -> DataFrame:
    """(item_id, ws, win): windows of each item's words and where they begin."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.filter(F.transform(raw_words(F.col("text")), lowered), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))
    return words.select("item_id", "words", F.explode(starts).alias("ws")).select("item_id", "ws", F.slice("words", F.col("ws") + 1, length).alias("win"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of those terms that occur."""
    tokens = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term"))
    return tokens.join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rare_places(wins: DataFrame, counts: DataFrame, rarest: int = 2) -> DataFrame:
    """(item_id, ws, win, places): places in the item of each window's rarest terms; windows with a term that no document has are left out."""
    terms = wins.select("item_id", "ws", F.posexplode("win").alias("at", "term")).join(counts, "term", "left")
    order = Window.partitionBy("item_id", "ws").orderBy(F.coalesce("n", F.lit(0)), "term", "at")
    ranked = terms.withColumn("rank", F.row_number().over(order)).withColumn("place", F.col("ws") + F.col("at"))
    chosen = ranked.groupBy("item_id", "ws").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.array_distinct(F.collect_list(F.when(F.col("rank") <= rarest, F.col("place")))).alias("places"), F.collect_list(F.when(F.col("rank") <= rarest, F.struct("place", "term"))).alias("anchors"))
    return wins.join(chosen.where("least > 0").drop("least"), ["item_id", "ws"])


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos): postings of the terms, stored in the shared folder; pos counts from 0 in `raw_words`."""
    tokens = docs.select("doc_id", F.posexplode(raw_words(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", lowered(F.col("w")).alias("term"))
    return materialise(tokens.join(small(terms), "term").select("term", "doc_id", "pos"), "postings")


def aligned(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift, places): places of an item whose rare terms a document has at one offset."""
    places = chosen.select("item_id", F.explode("anchors").alias("a")).select("item_id", "a.place", "a.term").distinct()
    lists = index.join(small(places), "term").select("doc_id", "item_id", (F.col("pos") - F.col("place")).alias("shift"), "place")
    return lists.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("place").alias("places"))  # as many as an item's words at most


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """All columns of `docs` with `words` (as in `raw_words`) and `hits`: an array of (a, b, item_id), words [a, b) of the document that equal a window.

    Columns of `docs` by these names, or named candidates, give way.
    """
    docs = docs.drop("words", "hits", "candidates")
    chosen, found = _candidates(docs, items, length)
    by_doc = found.groupBy("found_in").agg(F.collect_list(F.struct("item_id", "start", "win")).alias("candidates"))
    by_doc = small(materialise(by_doc, "candidates"), BROADCAST_ROWS // 10)
    held = docs.withColumn("words", raw_words(F.col("text"))).join(by_doc, docs["doc_id"].eqNullSafe(by_doc["found_in"]), "left").drop("found_in")

    def equal(c: Column) -> Column:
        return (c["start"] >= 0) & (F.transform(F.slice("words", F.greatest(c["start"], F.lit(0)) + 1, F.size(c["win"])), lowered) == c["win"])

    hits = F.transform(F.filter(F.coalesce("candidates", F.array().cast("array<struct<item_id:string,start:int,win:array<string>>>")), equal), lambda c: F.struct(c["start"].alias("a"), (c["start"] + F.size(c["win"])).alias("b"), c["item_id"].alias("item_id")))
    return held.withColumn("hits", hits).drop("candidates")


def _candidates(docs: DataFrame, items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    wins = materialise(windows(items, length), "windows")
    counts = term_counts(docs, wins.select(F.explode("win").alias("term")).distinct())
    chosen = materialise(rare_places(wins, counts), "chosen")
    index = build_index(docs, chosen.select(F.explode("anchors.term").alias("term")).distinct())
    by_item = chosen.groupBy("item_id").agg(F.collect_list(F.struct("ws", "win", "places")).alias("wins"))
    least = chosen.agg(F.min(F.size("places"))).first()[0] or 1
    both = aligned(index, chosen).where(F.size("places") >= least)
    full = F.filter("wins", lambda w: F.size(F.array_except(w["places"], F.col("places"))) == 0)
    found = both.join(small(by_item, BROADCAST_ROWS // 10), "item_id").select("doc_id", "item_id", "shift", F.explode(full).alias("w"))
    return chosen, found.select(F.col("doc_id").alias("found_in"), "item_id", (F.col("shift") + F.col("w.ws")).cast("int").alias("start"), F.col("w.win").alias("win"))


def proximity_matches(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, n_near): places of an item whose rare terms a document has, in another spacing by `slop` words or fewer than a neighbour's.

    Offsets are dealt to bands of slop + 1, each to two bands, so that near offsets meet; the fullest band counts.
    """
    wins = materialise(windows(items, length), "windows")
    counts = term_counts(docs, wins.select(F.explode("win").alias("term")).distinct())
    chosen = materialise(rare_places(wins, counts), "chosen")
    index = build_index(docs, chosen.select(F.explode("anchors.term").alias("term")).distinct())
    band = F.floor(F.col("shift") / (slop + 1))
    near = aligned(index, chosen).withColumn("band", F.explode(F.array(band, band + 1))).withColumn("place", F.explode("places"))
    return near.groupBy("doc_id", "item_id", "band").agg(F.count_distinct("place").alias("n")).where("n > 1").groupBy("doc_id", "item_id").agg(F.max("n").alias("n_near"))


def covered(hits: Column) -> Column:
    """Words in the union of hits."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(F.transform(hits, lambda h: F.struct(h["a"], h["b"]))), zero, lambda acc, h: F.struct(F.greatest(acc["end"], h["b"]).alias("end"), (acc["n"] + F.greatest(h["b"] - F.greatest(acc["end"], h["a"]), F.lit(0))).alias("n")), lambda acc: acc["n"].cast("long"))
