"""Near-duplicates by SimHash of word shingles, checked by exact Jaccard similarity.

Each distinct set of shingles has two independent fingerprints of 64 bits. Sets pair up if one of the two differs in `distance` bits or
fewer (`probing`, with partitions and thresholds of `simhash.plan` for each) and both together in `wide` or fewer; pairs are then
held against each other on their whole sets, and those of `percent` or more link. Nodes with many partners are asked again for those of other
components (`probing`), and their pairs are checked as lists, by tasks that hold the sets of two blocks of nodes. Links are exact. What they may miss are pairs
whose fingerprints lie further apart than their sets: with 14 bits and 40, of pairs of just 0.8 some three in a thousand, of 0.85 hardly any.

Fingerprints of small sets scatter more, so these have an exact way (`small_pairs`): pairs of 0.8 that have fewer than twelve shingles in common differ in two at
most, and meet by what is left of each when one or two are taken out. Sets that leave the same are alike through one of them.

Sets are of 64-bit hashes; equal hashes count as equal shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Rolling, bounded, materialise, mix, pieces, signed, small, utf8, word_bounds, word_hashes
from lodestone.llm.probing import search
from lodestone.llm.simhash import components, plan

#: Partners that one task reads to find the nodes among them.
IN_TASK = 4_000_000
#: Bytes of sets in a block.
CELL_BYTES = 16 << 20
#: Shingles of a set up to which it also meets others by what is left of it without one or two.
SMALL = 13
#: Documents that are read again by a broadcast of their ids, 8 MB; beyond it the join shuffles.
KNOWN = 1_000_000


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The ascending hashes of each text's distinct shingles; A-Z count as a-z, and a shorter text is one shingle."""
    data, offsets = utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = word_bounds(data, offsets)
    words = Rolling(word_hashes(data, starts, ends))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at = np.arange(a, b - min(shingle, b - a) + 1) if b > a else np.zeros(0, np.int64)
        out.append(np.unique(signed(words.of(at, at + min(shingle, b - a)))))
    return out


def _digest(hashes: np.ndarray) -> int:
    """Names a set."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


_LOWEST = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each set: bits set in over half its hashes; empty: zero. Eight bits are counted at a time, in bytes, 255 hashes at most."""
    out = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        begin, size = (np.cumsum(sizes) - sizes)[full], sizes[full]
        blocks = -(-size // 255)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
        counts = np.empty((len(starts), 8, 8), np.uint8)
        for j in range(8):
            counts[:, :, j] = np.add.reduceat(hashes >> np.uint64(j) & _LOWEST, starts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts.reshape(-1, 64), first, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, n, fp0, fp1, few) for each row: the set's name, its size, two fingerprints, and its hashes if it is small."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                found = shingle_sets(part.column("text"), shingle)
                sizes = np.array([len(x) for x in found], np.int64)
                hashes = np.concatenate([*found, np.zeros(0, np.int64)]).view(np.uint64)
                prints = [majority(x, sizes) for x in (hashes, mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)))]
                few = pa.array([x if len(x) <= SMALL else None for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_digest(x) for x in found], pa.int64()), pa.array(sizes), *map(pa.array, prints), few], names=["doc_id", "node", "n", "fp0", "fp1", "few"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, n long, fp0 long, fp1 long, few array<long>")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) for each row: the set's name and its hashes."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                found = shingle_sets(part.column("text"), shingle)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.int64()), lists], names=["node", "hashes"])

    return bounded(docs).select("text").mapInArrow(run, "node long, hashes array<long>")


def small_pairs(held: DataFrame, percent: int) -> DataFrame:
    """(a, held, more) as of `probing.search`: small sets (node, few) that may be alike as one or two shingles out of each leave the same.

    What is left is named by its hashes under exclusive or, so that each shingle is taken out in one step. Of the sets that leave the same,
    one that is it stands for all, else the first of those with one shingle more: with c left, i and j taken out of two sets, they
    are alike if c is `percent` of c + i + j or more, and all that are so with each other are so with it. A key of any number of sets makes as many pairs.
    """

    def alike_with(out: Column, left: Column) -> Column:
        return left * 100 >= (left + out) * percent

    name = F.aggregate("few", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    n = F.size("few")

    def left(name: Column, out: int) -> Column:
        return F.struct(name.alias("name"), (n - out).alias("left"), F.lit(out).alias("out"))

    without = F.transform("few", lambda x: F.col("name").bitwiseXOR(x))
    twice = F.flatten(F.transform("few", lambda x, i: F.transform(F.slice("few", i + 2, F.lit(SMALL)), lambda y: F.col("name").bitwiseXOR(x).bitwiseXOR(y))))
    made = [F.array(left(F.col("name"), 0)), F.transform(without, lambda x: left(x, 1)), F.transform(twice, lambda x: left(x, 2))]
    made = [F.filter(keys, lambda k: alike_with(F.greatest(k["out"], F.lit(1)), k["left"])) for keys in made]  # no partner can be alike otherwise
    keys = materialise(held.where("few is not null").select("node", "few", name.alias("name")).select("node", F.explode(F.concat(*made)).alias("k")).select("k.*", "node"), "left")
    heads = keys.groupBy("name", "left").agg(F.min(F.struct("out", "node")).alias("head"), F.count(F.lit(1)).alias("sets")).where((F.col("sets") > 1) & alike_with(2 * F.col("head.out"), F.col("left")))  # the others have as many out
    met = keys.join(heads, ["name", "left"]).where((F.col("node") != F.col("head.node")) & alike_with(F.col("out") + F.col("head.out"), F.col("left")))
    return met.select("node", F.col("head.node").alias("b")).distinct().select(F.col("node").alias("a"), F.array("b").alias("held"), F.lit(False).alias("more"))


def whole_sets(docs: DataFrame, held: DataFrame, found: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of all nodes in `found` (a, held), read again from the first document of each."""

    def once(batches):
        """Each task's nodes, so that lists of partners are never written out as pairs."""
        seen = np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("held").flatten().to_numpy(zero_copy_only=False)
            seen = np.union1d(seen, np.concatenate([batch.column("a").to_numpy(zero_copy_only=False), lists]))
            if len(seen) > KNOWN:
                yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["node"])
                seen = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen)], names=["node"])

    total = found.agg(F.sum(F.size("held").cast("long"))).first()[0] or 0
    nodes = materialise(found.select("a", "held").coalesce(total // IN_TASK + 1).mapInArrow(once, "node long").distinct(), "nodes")
    ids = materialise(held.join(nodes, "node", "left_semi").select(F.col("first").alias("_id")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(small(ids, KNOWN), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return materialise(sets(texts, shingle).join(small(nodes, KNOWN), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _one_by_one(whole: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs in `found`, both sets joined to each: for few pairs a node."""
    pairs = found.select("a", F.explode("held").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("u")), "a").join(whole.select(F.col("node").alias("b"), F.col("hashes").alias("v")), "b")
    common = F.size(F.array_intersect("u", "v"))
    return both.where(common * (100 + percent) >= (F.size("u") + F.size("v")) * percent).select("a", "b")


def _in_cells(whole: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The same for many pairs a node: nodes are dealt to blocks of CELL_BYTES, and a task holds of the sets of two blocks those that pairs between them name, and checks these.

    A set goes to the cells that some pair of it names, no others: to as many as it has partners at most.
    """
    total = whole.agg(F.sum(F.size("hashes").cast("long") * 8 + 64)).first()[0] or 0
    blocks = max(4, -(-total // CELL_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    parted = F.filter(F.transform(every, lambda j: F.struct(j.alias("j"), F.filter("held", lambda b: block(b) == j).alias("list"))), lambda x: F.size(x["list"]) > 0)
    asked = found.select("a", F.explode(parted).alias("p")).select((block("a") * blocks + F.col("p.j")).alias("cell"), F.lit(1).alias("kind"), F.col("a").alias("node"), F.col("p.list").alias("list"))
    asked = materialise(asked, "asked")
    named = asked.select("cell", F.explode(F.concat(F.array("node"), "list")).alias("node")).distinct()  # combined by each task first
    stored = named.join(whole, "node").select("cell", F.lit(0).alias("kind"), "node", F.col("hashes").alias("list"))
    dealt = stored.union(asked).repartition(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        cell, nodes, lists, order = None, [], [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind")], 1)
            names = batch.column("node").to_numpy(zero_copy_only=False)
            flat, offsets = batch.column("list").flatten().to_numpy(zero_copy_only=False), np.asarray(batch.column("list").offsets)
            offsets = offsets - offsets[0] if len(offsets) else offsets
            links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, (at, kind) in enumerate(marks.tolist()):
                if at != cell:
                    cell, nodes, lists, order = at, [], [], None
                held = flat[offsets[i] : offsets[i + 1]]
                if kind == 0:
                    nodes.append(names[i])
                    lists.append(held.copy())
                    continue
                if order is None:
                    order = np.argsort(np.array(nodes, np.int64))
                    known, hashes = np.array(nodes, np.int64)[order], [lists[j] for j in order]
                mine = hashes[int(np.searchsorted(known, names[i]))]
                theirs = [hashes[j] for j in np.searchsorted(known, held).tolist()]
                for begin in range(0, len(theirs), 256):
                    links.append(_links(names[i], mine, held[begin : begin + 256], theirs[begin : begin + 256], percent))
            a, b = (np.concatenate(x) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _links(node: int, mine: np.ndarray, partners: np.ndarray, theirs: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of one node with those of its partners that are alike."""
    size = np.array([len(x) for x in theirs])
    flat = np.concatenate(theirs)
    inside = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat if len(mine) else np.zeros(0, bool)
    common = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(size)])])
    alike = partners[common * (100 + percent) >= (size + len(mine)) * percent]
    return np.minimum(alike, node), np.maximum(alike, node)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, distance: int = 14, wide: int = 40, emit: int = 4) -> DataFrame:
    """(doc_id, component_id) for each row of `docs` (doc_id, text): the smallest doc_id that links connect.

    Null and wordless texts are equal. Rows without doc_id stay, without component unless others share theirs. Repeated doc_ids are rows of
    their own. Other columns of `docs` are not read.
    """
    marked = materialise(sketches(docs, shingle), "sketches")
    held = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "fp0", "fp1", "few"))), "distinct")
    n = held.count()
    parts = [(table, bits, most) for table in (0, 1) for bits, most in plan(held.select(F.col(f"fp{table}").alias("fp")), distance)]
    nodes = held.select("node", "n", F.col("node").alias("root"), F.lit(True).alias("asks"), "fp0", "fp1")
    links, roots, first = None, None, True
    while True:
        found = search(nodes, parts, 2, n, distance, wide, percent, emit, first)
        if first:
            found = materialise(found.unionByName(small_pairs(held, percent)), "found")
        whole = whole_sets(docs, held, found, shingle)
        more = materialise((_one_by_one if first else _in_cells)(whole, found, percent), "links")
        links = more if links is None else links.union(more)
        roots = components(links)
        again = found.where("more").select(F.col("a").alias("node"))
        if again.isEmpty():
            break
        rooted = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        nodes = rooted.join(again.withColumn("asked", F.lit(True)), "node", "left").select("node", "n", "root", F.col("asked").isNotNull().alias("asks"), "fp0", "fp1")
        emit, first = emit * 64, False
    rooted = held.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = rooted.join(ids, "root").select("node", "component_id")
    return marked.select("doc_id", "node").join(labelled, "node").select("doc_id", "component_id")
