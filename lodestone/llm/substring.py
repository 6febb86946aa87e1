"""Repeated passages by level-wise doubling.

Level 1 looks at windows of half the wanted length. Of the half-length windows inside each full-length window only the one
with the smallest hash is taken (so equal full-length windows take the same one). Those whose words occur in more than one document
survive; the rest of the corpus is never looked at again. Level 2 extends each survivor to every full-length window around
it. Occurrences with the same words all around form a class and are settled by one comparison of doc_ids; only the
first document of each class is extended word by word, and only where a half-length window has several classes. No
candidates, no level. Windows longer than the wanted length change nothing, so the doubling ends there.

Hashes: 64 bits of the half-length window together with 64 of what stands around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Rolling, bounded, materialise, pieces, signed, utf8, word_bounds, word_hashes

#: Ids that may be broadcast, some 10 MB; beyond it the texts are shuffled unfiltered.
BROADCAST_IDS = 500_000
#: pos and last are the first and the last place of a run of places with the same hashes, none further from the next than a half-length
#: window, so that what they cover is one range; texts that repeat a few words have many such places.
SEED = "h long, ctx long, doc_id long, pos int, last int, lo int, hi int"


def _words(part: pa.RecordBatch) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Rolling hashes over the words of a piece, word hashes, and the first word of each text."""
    data, offsets = utf8(part.column("text"))
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    return Rolling(hashes), hashes, first


def _seeds(part: pa.RecordBatch, words: int, half: int) -> pa.RecordBatch:
    rolling, hashes, first = _words(part)
    n, span = len(hashes), words - half + 1
    doc = np.repeat(np.arange(len(part)), np.diff(first))
    stop = first[1:][doc]
    at = np.arange(n)
    short = np.zeros(n, np.uint64)
    fits = np.flatnonzero(at + half <= stop)
    short[fits] = rolling.of(fits, fits + half)
    window = np.flatnonzero(at + words <= stop)
    least = short[window].copy()
    for j in range(1, span):
        np.minimum(least, short[window + j], out=least)
    chosen = np.zeros(n, bool)
    for j in range(span):
        chosen[window[short[window + j] == least] + j] = True
    pos = np.flatnonzero(chosen)
    begin = np.maximum(first[:-1][doc[pos]], pos - (words - half))
    end = np.minimum(stop[pos], pos + words)
    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
    around = rolling.of(begin, end) + (pos - begin).astype(np.uint64)
    h, of = short[pos], doc[pos]
    order = np.lexsort((pos, around, h, of))
    h, around, of, pos, begin, end = (x[order] for x in (h, around, of, pos, begin, end))
    fresh = np.ones(len(pos), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (of[1:] != of[:-1]) | (np.diff(pos) > half)
    one = np.flatnonzero(fresh)
    last = pos[np.append(one[1:], len(pos)) - 1] if len(one) else pos
    base = first[:-1][of[one]]
    ints = [(x - y).astype(np.int32) for x, y in ((pos[one], base), (last, base), (pos[one], begin[one]), (end[one], pos[one]))]
    return pa.RecordBatch.from_arrays([pa.array(signed(h[one])), pa.array(signed(around[one])), pa.array(ids[of[one]]), *map(pa.array, ints)], names=["h", "ctx", "doc_id", "pos", "last", "lo", "hi"])


def repeated_ranges(docs: DataFrame, words: int = 50) -> DataFrame:
    """(doc_id, ranges): ranges of words [a, b) that lie in windows which also start in a document with a smaller doc_id.

    Ranges may overlap. Documents without any are missing. Rows without doc_id are left out; rows that share a doc_id count as one document.
    """
    half = (words + 1) // 2
    texts = bounded(docs).select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")

    def seed(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                yield _seeds(part, words, half)

    seeds = materialise(texts.mapInArrow(seed, SEED), "seeds")
    several = seeds.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    several = several.where("low < high").select("h", (F.col("c0") == F.col("c1")).alias("alike"))
    survivors = materialise(seeds.join(several, "h"), "survivors")
    classes = materialise(survivors.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.first("alike").alias("alike")), "classes")
    is_later = F.col("doc_id") > F.col("first.doc_id")
    placed = survivors.drop("alike").join(classes, ["h", "ctx"]).withColumn("later", is_later).where("later or not alike").drop("first", "alike")
    placed = materialise(placed, "placed")
    later = placed.where("later").select("doc_id", (F.col("pos") - F.col("lo")).alias("a"), (F.col("last") + F.col("hi")).alias("b"))

    heads = classes.where("not alike").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("h", "ctx", F.col("first.pos").alias("pos"))).alias("heads"))
    heads = materialise(heads, "heads")
    headed = texts
    if heads.count() <= BROADCAST_IDS:
        headed = texts.join(F.broadcast(heads.select("doc_id")), "doc_id", "left_semi")  # fewer texts to shuffle

    def extend(batches):
        """Each full-length window around each head."""
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                rolling, _, first = _words(part)
                lists = part.column("heads")
                flat, bounds = lists.flatten(), np.asarray(lists.offsets)
                count = np.diff(bounds)
                doc = np.repeat(np.arange(len(part)), count)
                pos = flat.field("pos").to_numpy() + first[:-1][doc]
                low = np.maximum(first[:-1][doc], pos - (words - half))
                many = np.maximum(np.minimum(pos, first[1:][doc] - words) - low + 1, 0)
                k = np.repeat(np.arange(len(pos)), many)
                begin = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays([flat.field("h").take(take), flat.field("ctx").take(take), part.column("doc_id").take(pa.array(doc[k])), pa.array((pos[k] - begin).astype(np.int32)), pa.array(signed(rolling.of(begin, begin + words)))], names=["h", "ctx", "doc_id", "back", "w"])

    windows = materialise(headed.join(heads.hint("shuffle_hash"), "doc_id").mapInArrow(extend, "h long, ctx long, doc_id long, back int, w long"), "windows")
    known = windows.groupBy("h", "w").agg(F.min("doc_id").alias("low"))
    again = windows.join(known, ["h", "w"]).where("low < doc_id").groupBy("h", "ctx").agg(F.collect_list("back").alias("backs"))  # at most words - half + 1 for each class
    heads_again = placed.where("not later").join(again, ["h", "ctx"]).select("doc_id", F.explode("backs").alias("back"), "pos", "last")
    heads_again = heads_again.select("doc_id", (F.col("pos") - F.col("back")).alias("a"), (F.col("last") - F.col("back") + words).alias("b"))
    return later.unionByName(heads_again).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def remove_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of `docs` (doc_id, text); kept is the rest of the words, joined by one space.

    Null and empty texts have no words. A row without doc_id keeps all its words.
    """
    texts = bounded(docs).select(F.col("doc_id").cast("long"), "text")

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                rows = []
                for text, ranges in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("ranges").to_pylist()):
                    found = (text or b"").split()
                    n = len(found)
                    if ranges:
                        steps = np.zeros(n + 1, np.int32)
                        np.add.at(steps, [r["a"] for r in ranges], 1)
                        np.add.at(steps, [r["b"] for r in ranges], -1)
                        found = [w for w, covered in zip(found, np.cumsum(steps).tolist()) if not covered]
                    rows.append((n, n - len(found), b" ".join(found)))
                n, removed, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(repeated_ranges(docs, words).hint("shuffle_hash"), "doc_id", "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


