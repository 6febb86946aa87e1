"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are searched, never documents: a group of copies is one row. Bits that correlate over the corpus are
put into one partition. If thresholds t_i of the partitions satisfy sum(t_i + 1) = t + 1, two fingerprints within t bits differ
by t_i or fewer in some partition i (t_i = -1: the partition is not probed). A dynamic program shares out the t + 1 units so
that the candidates and probes expected, from counts over all fingerprints, are fewest. Probing joins keys (a partition's
value, with up to t_i bits flipped); pairs are verified by popcount.

A bucket with more than `crowded` fingerprints is not paired. Its members join through what fingerprints within two bits
have in common: each fingerprint stands for itself and its neighbours at one bit, and those that share such a point link to its
smallest, 65 rows each however large the bucket. That way is exact for two bits or fewer and has no limit on partners; larger distances
go through `probing`.

Links become components by alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, pieces
from lodestone.llm.probing import gathered_bits, packed, search

BITS = 64
#: Links in a file of a round of `components`; rounds are many and links few, so small files would outnumber them.
EDGES_IN_FILE = 200_000


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the hashes of all shingles; no words: zero."""
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    span = min(shingle, len(words))
    begin = [0, *(ends[: len(words) - span] + 1).tolist()]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin, ends[span - 1 :].tolist())], "<u8")
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = np.array([fingerprint(t or b"", shingle) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits agree over all distinct fingerprints, and their number: 64 x 64 sums for each task, added up."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64) * 2 - 1
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        pair = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(pair, -1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    sums = {r.cell: r.n for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # 4,097 rows
    return np.array([sums.get(i, 0) for i in range(BITS * BITS)]).reshape(BITS, BITS), sums.get(-1, 0)


def partition_bits(agree: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Groups of equal width; each begins with the first bit left and takes the bits that correlate most with it."""
    strength = np.abs(agree) / max(n, 1)
    left, groups = list(range(BITS)), []
    for k in range(parts, 0, -1):
        width = -(-len(left) // k)
        group = [left.pop(0)]
        while len(group) < width:
            best = max(left, key=lambda b: (round(float(strength[b, group].sum()), 9), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t_i + 1) = units and the least total cost; costs[i][u] is that of u units (threshold u - 1) in partition i."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
    for cost in costs:
        best = [min(((best[u - v][0] + cost[v], [*best[u - v][1], v - 1]) for v in range(u + 1)), key=lambda x: x[0]) for u in range(units + 1)]
    return best[units]


def flips(width: int, most: int) -> list[int]:
    """Masks over a partition's own bits with up to `most` set, as signed longs."""
    masks = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def plan(fps: DataFrame, distance: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, chosen among divisions into 1 to distance + 1 partitions, `most_parts` at most."""
    agree, n = bit_counts(fps)
    divisions = {parts: partition_bits(agree, n, parts) for parts in range(1, min(distance + 1, most_parts) + 1)}
    columns = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(BITS)]
    row = fps.agg(*columns).first()
    ones = np.array([(row[b] or 0) / max(n, 1) for b in range(BITS)])
    same = np.maximum(ones**2 + (1 - ones) ** 2, 0.5)  # two fingerprints agree on the bit

    def keys(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for parts, groups in divisions.items():
                for i, g in enumerate(groups):
                    key, count = np.unique(gathered_bits(fp, g), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), parts * BITS + i, np.int32)), pa.array(key), pa.array(count)], names=["part", "key", "n"])

    sizes = fps.select("fp").mapInArrow(keys, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
    found = sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()  # a row for each partition
    pairs = {r.part: r.pairs for r in found}
    best: tuple[float, list] = (float("inf"), [])
    for parts, groups in divisions.items():
        costs = []
        for i, group in enumerate(groups):
            # polynomial of the number of bits that differ, given the chance of each
            spread = np.array([1.0])
            for b in group:
                spread = np.convolve(spread, [1.0, (1 - same[b]) / same[b]])
            probes = np.cumsum([float(comb(len(group), t)) for t in range(distance + 1)])
            costs.append([0.0] + [probes[t] * n + pairs.get(parts * BITS + i, 0.0) * float(spread[: t + 1].sum()) for t in range(distance + 1)])
        cost, thresholds = allocate(costs, distance + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def links(fps: DataFrame, distance: int = 2, crowded: int = 64) -> DataFrame:
    """(a, b): fingerprints a < b within `distance` bits, enough of them to connect all that are; `fps` has distinct fp."""
    chosen = plan(fps, distance)
    if distance > 2:
        return _probed(fps, chosen, distance)
    found = []
    crowds = []
    for bits, threshold in chosen:
        masks = flips(len(bits), threshold)
        held = fps.select("fp", packed(F.col("fp"), bits).alias("key"))
        probes = held.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col("key").bitwiseXOR(m))).alias("key")) if len(masks) > 1 else held
        sizes = probes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        few = sizes.where(F.col("size") <= crowded)
        a = probes.join(few, "key").select("key", F.col("fp").alias("a"))
        b = held.join(few, "key").select("key", F.col("fp").alias("b"))
        found.append(a.join(b, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        crowds.append(probes.join(sizes.where(F.col("size") > crowded), "key").select("fp"))
    crowd = crowds[0]
    for more in crowds[1:]:
        crowd = crowd.union(more)
    found.append(_through_points(crowd.distinct(), distance))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _probed(fps: DataFrame, chosen: list[tuple[list[int], int]], distance: int, emit: int = 64) -> DataFrame:
    """Links of any distance by `probing`: in rounds, as groups of near copies have more links than components need."""
    n, parts = fps.count(), [(0, bits, most) for bits, most in chosen]
    held = fps.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("n"), F.col("fp").alias("fp0"))
    nodes = held.select("node", "n", F.col("node").alias("root"), F.lit(True).alias("asks"), "fp0")
    out, first = None, True
    while True:
        found = search(nodes, parts, 1, n, distance, distance, 0, emit, first)
        pairs = found.select("a", F.explode("held").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = pairs if out is None else out.union(pairs)
        again = found.where("more").select(F.col("a").alias("node"))
        if again.isEmpty():
            return out
        rooted = held.join(components(out), "node", "left").join(again.withColumn("asked", F.lit(True)), "node", "left")
        nodes = rooted.select("node", "n", F.coalesce("root", "node").alias("root"), F.col("asked").isNotNull().alias("asks"), "fp0")
        emit, first = emit * 8, False


def _through_points(fps: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints by shared points at half the distance; exact for two bits or fewer."""
    masks = flips(BITS, min(distance, 1))
    points = fps.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    if distance == 1:
        points = points.where("point = fp or point < fp")  # a point between is one of the two
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a")
    star = points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of `edges` (a, b); root is the smallest node reachable."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    size, unsettled = _shape(now)
    for _ in range(rounds):
        if not unsettled:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        next_ = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(next_.coalesce(size // EDGES_IN_FILE + 1), "edges")
        size, unsettled = _shape(now)
    else:
        if unsettled:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """How many links, and whether they are other than stars: a node with two roots, or a root that has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = by_node.agg(F.sum("up").alias("n"), F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("more")).first()
    return row.n or 0, bool(row.more)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text).

    Null and wordless texts have fingerprint zero and link like any other. Rows without doc_id stay, without component unless others
    share theirs. Repeated doc_ids are rows of their own.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    held = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(held.select("fp"), distance)
    firsts = held.select(F.col("fp"), "first")
    by_doc = edges.join(firsts.withColumnRenamed("fp", "a"), "a").select("b", F.col("first").alias("x")).join(firsts.withColumnRenamed("fp", "b"), "b").select(F.col("x").alias("a"), F.col("first").alias("b"))
    roots = components(by_doc)
    labelled = held.join(roots.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")
