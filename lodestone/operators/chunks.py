"""Content-defined chunks: cuts follow the text near them, so an edit moves only the cuts around it."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import length_prefixed_sha256

#: Sizes of chunks in characters and UTF-8 bytes, and the fingerprint's parameters.
TARGET, MOST, MOST_BYTES = 2400, 3600, 1800
RADIUS, WIDEST = 32, 4
OFFSET, PRIME, WORD = 1469598103934665603, 1099511628211, (1 << 64) - 1


def ranks(text: str) -> np.ndarray:
    """For each cut before character i: 0 at the end of a paragraph, 1 of a sentence, 2 of a word, 3 elsewhere."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.fromiter(map(str.isspace, text), bool, n)
    line, cr = codes == 10, codes == 13
    out = np.full(n + 1, 3)
    out[1:][space] = 2
    after = np.append(space[1:], True)
    out[1:][np.isin(codes, [33, 46, 63]) & after] = 1
    blank = np.zeros(n, bool)
    blank[1:] = line[1:] & line[:-1]
    blank[2:] |= line[2:] & cr[1:-1] & line[:-2]
    out[1:][blank] = 0
    return out


def fingerprints(text: str, radius: int) -> np.ndarray:
    """For each cut a hash of the `radius` characters before it, or of as many as there are."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n, prime = len(codes), np.uint64(PRIME)
    size = np.minimum(np.arange(n + 1), radius).astype(np.uint64)
    value = (np.uint64(OFFSET) ^ size) * prime
    for j in range(min(radius, n), 0, -1):
        value[j:] = (value[j:] ^ codes[: n + 1 - j]) * prime
    return value


class _Limits:
    def __init__(self, text: str, target: int, most: int, most_bytes: int):
        self.n, self.target, self.most, self.most_bytes = len(text), target, most, most_bytes
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        self.bytes = [0, *np.cumsum(sizes).tolist()]

    def reach(self, start: int) -> int:
        """The last place where a chunk from `start` may end."""
        by_bytes = bisect_right(self.bytes, self.bytes[start] + self.most_bytes) - 1
        return min(start + self.most, self.n, max(start + 1, by_bytes))


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by doubling."""
    out, width = values, 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - span + 1], out[span - width :]) if span > width else out


def _minima(places: np.ndarray, total: int, span: int, scores: np.ndarray) -> set[int]:
    """Cuts that have the least score of some window of `span` positions, the last of equals; cut i + 1 is at places[i].

    A window whose least score is that of the window before adds nothing.
    """
    if span <= 0 or total <= span or not len(places):
        return set()
    grid, cut_at = np.full(total, np.iinfo(np.int64).max), np.zeros(total, np.int64)
    grid[places], cut_at[places] = scores[1 : len(places) + 1], np.arange(1, len(places) + 1)
    least = _sliding_least(grid[1:], span)
    fresh = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    chosen = set()
    for i in fresh.tolist():
        window = grid[1 + i : 1 + i + span]
        if least[i] < np.iinfo(np.int64).max:
            chosen.add(int(cut_at[1 + i + np.flatnonzero(window == least[i])[-1]]))
    return chosen


def _first_cut(text: str, limits: _Limits, rank: np.ndarray) -> tuple[int, bool]:
    """The best natural end of the first chunk (nearest to the target, later on ties), or the target itself; 0 if all fits."""
    hard = limits.reach(0)
    if hard == len(text):
        return 0, False
    target = min(limits.target, hard)
    for best in (0, 1, 2):
        if len(found := np.flatnonzero(rank[1 : hard + 1] == best) + 1):
            return int(min(found.tolist(), key=lambda at: (abs(at - target), -at))), True
    return target, False


def windows(text: str, target: int = TARGET, most: int = MOST, most_bytes: int = MOST_BYTES) -> list[tuple[int, int]]:
    """[start, end) of each chunk; they cover the whole text."""
    n = len(text)
    if not n:
        return []
    limits = _Limits(text, target, most, most_bytes)
    radius = min(RADIUS, max(1, min(target, most) // 4))
    rank = ranks(text)
    both = np.empty(n + 1, [("rank", "i8"), ("fingerprint", "u8")])
    both["rank"], both["fingerprint"] = rank, fingerprints(text, radius)
    order = np.lexsort((both["fingerprint"], both["rank"]))
    scores = np.empty(n + 1, np.int64)
    scores[order] = np.cumsum(np.append(False, both[order][1:] != both[order][:-1]))  # equal scores have equal numbers
    chosen = _minima(np.arange(1, n), n, max(1, most - radius), scores)
    chosen |= _minima(np.asarray(limits.bytes[1:n]), limits.bytes[n], most_bytes - radius * WIDEST, scores)
    first, natural = _first_cut(text, limits, rank)
    if first:
        limit = first - 1 if natural else limits.reach(first)
        chosen = {at for at in chosen if at > limit} | {first}
    cuts: list[int] = []
    for at in sorted(chosen):
        loose = at != first and rank[at] > 1
        if loose and cuts and cuts[-1] != first and rank[cuts[-1]] > 1 and at - cuts[-1] < radius:
            cuts[-1] = at  # a burst of cuts: the last one stands
        else:
            cuts.append(at)
    ends, start = [], 0
    for end in [*cuts, n]:
        while end > limits.reach(start):
            start = min(start + target, limits.reach(start))
            ends.append(start)
        if start < end < n:
            ends.append(end)
        start = max(start, end)
    return list(zip([0, *ends], [*ends, n]))


def chunked(df: DataFrame, key: str, text: str, **sizes: int) -> DataFrame:
    """(key, ordinal, start, end, text): trimmed chunks with their places; empty ones go."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for ordinal, (a, b) in enumerate(windows(t or "", **sizes)):
                    piece = t[a:b]
                    left = len(piece) - len(piece.lstrip())
                    if piece := piece.strip():
                        rows.append((k, ordinal, a + left, a + left + len(piece), piece))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=[key, "ordinal", "start", "end", "text"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, ordinal int, start int, end int, text string")


def projection(chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct chunks by content, and every place where one occurs."""
    named = chunks.withColumn("chunk_id", length_prefixed_sha256(F.lit("chunk"), F.col("text")))
    return named.groupBy("chunk_id").agg(F.first("text").alias("text")), named.select("chunk_id", key, "ordinal", "start", "end")


def difference(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """One row: created, updated, reused and deleted rows between two projections."""
    both = old.select(*key, F.col(digest).alias("_old")).join(new.select(*key, F.col(digest).alias("_new")), key, "full_outer")
    count = lambda c, name: F.count_if(c).alias(name)
    return both.agg(count(F.col("_old").isNull(), "created"), count(F.col("_old") != F.col("_new"), "updated"), count(F.col("_old") == F.col("_new"), "reused"), count(F.col("_new").isNull(), "deleted"))


def capped_counts(places: DataFrame, chunk: str, parent: str, limit: int, held: int = 200_000) -> DataFrame:
    """(chunk, n): in how many different parents each chunk stands, `limit` + 1 for all that stand in more.

    Each task keeps at most `limit` + 1 parents of a chunk and passes on what it has when it knows `held` chunks, so a chunk that every parent has ships so many rows for each
    task and no more. Null chunks and parents do not count.
    """
    if limit < 0:
        raise ValueError("limit is negative")
    rows = places.where(F.col(chunk).isNotNull() & F.col(parent).isNotNull()).select(F.col(chunk).alias("chunk"), F.col(parent).alias("parent"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        known: dict = {}
        schema = None

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known), schema.field("chunk").type), pa.array([list(v) for v in known.values()], pa.list_(schema.field("parent").type))], names=["chunk", "parents"])
            known.clear()
            return out

        for b in batches:
            schema = b.schema
            for c, p in zip(b.column("chunk").to_pylist(), b.column("parent").to_pylist()):
                some = known.setdefault(c, set())
                if len(some) <= limit:
                    some.add(p)
            if len(known) >= held:
                yield passed_on()
        if known:
            yield passed_on()

    few = rows.mapInArrow(run, f"chunk {kinds['chunk']}, parents array<{kinds['parent']}>").select("chunk", F.explode("parents").alias("parent"))
    counts = few.groupBy("chunk").agg(F.count_distinct("parent").alias("n"))
    return counts.select(F.col("chunk").alias(chunk), F.least("n", F.lit(limit + 1)).alias("n"))


def hydrated(ids: DataFrame, chunks: DataFrame, parents: list[DataFrame], most: int = 1000) -> DataFrame:
    """Chunk rows of the asked ids (chunk_id) with their parents' fields, by chunk_id. `chunks` has chunk_id, kind and parent besides its own columns, each of `parents` the same columns with kind,
    parent, note and current.

    Ids are trimmed, each counts once, empty ones go; more than `most` are refused. A chunk without a current parent that has a note is left out.
    """
    asked = ids.select(F.trim("chunk_id").alias("chunk_id")).where("chunk_id <> ''").distinct()
    if len(asked.limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} chunks")
    every = parents[0]
    for more in parents[1:]:
        every = every.unionByName(more)
    every = every.where((F.trim(F.coalesce("note", F.lit(""))) != "") & F.coalesce("current", F.lit(False))).drop("current")
    found = chunks.join(F.broadcast(asked), "chunk_id")  # `most` rows
    return every.join(F.broadcast(found), ["kind", "parent"]).orderBy("chunk_id")  # a chunk has one parent
