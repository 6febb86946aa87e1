"""Fingerprints within a distance, found in buckets: the probes of the generalised pigeonhole plan.

Each partition of the plan (its bits and its threshold) is cut in two. The coarse bits name a bucket: a fingerprint is stored in its
own bucket and asks in all buckets that few enough of its coarse bits flipped lead to. What is left of the threshold
is spent on the fine bits inside the bucket, where masks are looked up in an array sorted by them, so that probes are
never rows of a shuffle. Of two fingerprints in different buckets one asks, of two in one bucket the one with the larger node.

Buckets with more than BUCKET fingerprints are dealt to several tasks, and asked in each. A node that asks and has more than `emit` partners
gives its smallest ones and is asked again once links have made components, then for partners of other
components alone and with a larger `emit`, until none has too many: no partner is lost, and a group of near copies is never
written as all its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, small

#: Stored fingerprints of a bucket that one task holds, some 4 MB.
BUCKET = 100_000
#: Candidates behind one mask that are looked at, at least; if there are more the node is asked again.
ROOM = 1024
#: Lookups or candidates in one step.
STEP = 1 << 17

#: A partition: the table its bits are of, the bits, the threshold.
Part = tuple[int, list[int], int]


def masks(width: int, most: int) -> np.ndarray:
    """All masks of `width` bits with up to `most` set."""
    return np.array([sum(1 << b for b in c) for k in range(min(most, width) + 1) for c in combinations(range(width), k)], np.int64)


def packed(fp: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint, moved together."""
    out = F.lit(0).cast("long")
    for to, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), to))
    return out


def gathered_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The same of an array."""
    out = np.zeros(len(fp), np.int64)
    for to, b in enumerate(bits):
        out |= (fp >> b & 1) << to
    return out


def coarse_bits(n: int, width: int) -> int:
    """Bits that name buckets: enough for half-full buckets, three at least for the sake of many tasks."""
    return min(width, max(3, ceil(log2(max(n, 1) * 2 / BUCKET)))) if width > 3 else 0


class Bucket:
    """The stored fingerprints of a bucket, sorted by fine bits, then root, then node."""

    def __init__(self, part: Part, fine: list[int], rows: dict[str, np.ndarray], first: bool):
        self.table, self.fine, self.first = part[0], fine, first
        key = gathered_bits(rows["fp"][:, part[0]], fine)
        self.roots, rank = (np.zeros(1, np.int64), np.zeros(len(key), np.int64)) if first else np.unique(rows["root"], return_inverse=True)
        order = np.lexsort((rows["node"], rank, key))
        self.rows = {name: x[order] for name, x in rows.items()}
        self.prints = self.rows["fp"][:, part[0]].copy().view(np.uint64)
        self.keys = (key * len(self.roots) + rank)[order]
        width = len(fine)
        self.starts = np.searchsorted(self.keys, np.arange((1 << width) + 1) * len(self.roots)).astype(np.int32) if width <= 18 else None

    def ranges(self, ask: dict[str, np.ndarray], flips: np.ndarray):
        """(lo, hi) of what each of `ask` may meet through each mask, own root left out: one or two arrays of (ask, mask)."""
        key = gathered_bits(ask["fp"][:, self.table], self.fine)[:, None] ^ flips
        n = len(self.roots)
        if self.starts is None:
            lo, hi = np.searchsorted(self.keys, key * n), np.searchsorted(self.keys, (key + 1) * n)
        else:
            lo, hi = self.starts[key], self.starts[key + 1]
        if self.first:
            return [(lo, hi)]
        rank = np.minimum(np.searchsorted(self.roots, ask["root"]), n - 1)
        own = self.roots[rank] == ask["root"]
        at = key * n + rank[:, None]
        begin, end = np.searchsorted(self.keys, at), np.searchsorted(self.keys, at + own[:, None])
        return [(lo, begin), (end, hi)]


def _spread(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ask, stored) of all ranges."""
    flat = size.ravel()
    used = np.flatnonzero(flat)
    flat = flat[used]
    upto = np.cumsum(flat, dtype=np.int32)
    at = np.repeat(lo.ravel()[used] - (upto - flat), flat)
    at += np.arange(len(at), dtype=np.int32)
    return np.repeat((used // size.shape[1]).astype(np.int32), flat), at


def _meet(bucket: Bucket, ask: dict[str, np.ndarray], same: bool, flips: np.ndarray, distance: int, wide: int, percent: int, emit: int):
    """Nodes that ask and have partners, how many are given, the partners, and whether there are more."""
    over = np.zeros(len(ask["node"]), bool)
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    held = bucket.rows
    mine = ask["fp"][:, bucket.table].copy().view(np.uint64)
    for lo, hi in bucket.ranges(ask, flips):
        size = np.maximum(hi - lo, 0).astype(np.int32)
        room = max(8 * emit, ROOM)
        over |= (size > room).any(1)
        size, lo = np.minimum(size, np.int32(room)), lo.astype(np.int32)
        total = np.cumsum(size.sum(1))
        begin = 0
        while begin < len(total):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP, "right")))
            who, at = _spread(lo[begin:end], size[begin:end])
            near = np.flatnonzero(np.bitwise_count(mine[begin:end][who] ^ bucket.prints[at]) <= distance)
            who, at = who[near] + begin, at[near]
            good = np.bitwise_count((ask["fp"][who] ^ held["fp"][at]).view(np.uint64)).sum(1, dtype=np.int64) <= wide
            good &= (held["node"][at] < ask["node"][who]) if same else (held["node"][at] != ask["node"][who])
            x, y = ask["n"][who], held["n"][at]
            good &= np.minimum(x, y) * 100 >= np.maximum(x, y) * percent
            found.append((who[good], held["node"][at[good]]))
            begin = end
    who, partner = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((partner, who))
    who, partner = who[order], partner[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    over[who[place >= emit]] = True
    keep = place < emit
    count = np.bincount(who[keep], minlength=len(over))
    some = np.flatnonzero((count > 0) | over)
    return ask["node"][some], count[some], partner[keep], over[some]


def _rows(batch: pa.RecordBatch, tables: int) -> dict[str, np.ndarray]:
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    return {"node": get("node"), "n": get("n"), "root": get("root"), "fp": np.stack([get(f"fp{i}") for i in range(tables)], 1)}


def search(nodes: DataFrame, parts: list[Part], tables: int, n: int, distance: int, wide: int, percent: int = 0, emit: int = 8, first: bool = True) -> DataFrame:
    """(a, held, more): nodes that ask, the partners whose fingerprints are near, `emit` at most, and whether to ask again for others.

    `nodes` has node, n (sizes, at least `percent` of each other), root, asks and fp0 to fp(tables - 1), of which `distance` bits may
    differ in the table of some part and `wide` in all. Unless it is the `first` time, partners have other roots.
    """
    spark = nodes.sparkSession
    coarse = [bits[: coarse_bits(n, len(bits))] for _, bits, _ in parts]
    fine = [bits[len(c) :] for (_, bits, _), c in zip(parts, coarse)]
    flips = [masks(len(c), most) for (_, _, most), c in zip(parts, coarse)]
    prints = [f"fp{i}" for i in range(tables)]
    columns = ["node", "n", "root", *prints]

    def entries(batches):
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for i, ((table, _, _), c) in enumerate(zip(parts, coarse)):
                key = gathered_bits(batch.column(f"fp{table}").to_numpy(zero_copy_only=False), c)
                at, bucket, k = [np.arange(len(key))], [key], [np.full(len(key), -1)]
                for flip in flips[i].tolist():
                    moved = key ^ flip
                    at.append(np.flatnonzero(asks & (moved >= key)))  # of two buckets the one with the smaller key asks
                    bucket.append(moved[at[-1]])
                    k.append(np.full(len(at[-1]), flip.bit_count()))
                rows = batch.select(columns).take(pa.array(np.concatenate(at)))
                marks = [np.full(len(rows), i), np.concatenate(bucket), np.concatenate(k)]
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(t)) for m, t in zip(marks, (np.int32, np.int64, np.int32))] + rows.columns, names=["part", "bucket", "k", *columns])

    def stored(batches):
        for batch in batches:
            for i, ((table, _, _), c) in enumerate(zip(parts, coarse)):
                bucket, count = np.unique(gathered_bits(batch.column(f"fp{table}").to_numpy(zero_copy_only=False), c), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket), pa.array(count)], names=["part", "bucket", "n"])

    spread = nodes.select("asks", *columns).mapInArrow(entries, "part int, bucket long, k int, " + ", ".join(f"{c} long" for c in columns))
    sizes = nodes.select(*prints).mapInArrow(stored, "part int, bucket long, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET)
    crowded = sizes.select("part", "bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("deals"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("deals")).cast("int"))
    deal = F.when(F.col("deals").isNull(), F.array(F.lit(0))).when(F.col("k") == -1, own).otherwise(F.sequence(F.lit(0), F.col("deals") - 1))
    dealt = spread.join(small(crowded), ["part", "bucket"], "left").withColumn("deal", F.explode(deal))
    keys = ["part", "bucket", "deal"]
    dealt = dealt.select(*keys, "k", *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "k")

    def run(batches):
        now, waiting, bucket = None, [], None
        known: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "bucket", "deal", "k")], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            met = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            for begin, end in zip(cuts, cuts[1:]):
                *at, k = marks[begin].tolist()
                rows = _rows(batch.slice(begin, end - begin), tables)
                if at != now:
                    now, waiting, bucket = at, [], None
                if k == -1:
                    waiting.append(rows)
                    continue
                if not waiting:
                    continue
                if bucket is None:
                    bucket = Bucket(parts[at[0]], fine[at[0]], {name: np.concatenate([w[name] for w in waiting]) for name in waiting[0]}, first)
                left = (len(fine[at[0]]), parts[at[0]][2] - k)
                if left not in known:
                    known[left] = masks(*left)
                step = max(1, STEP // len(known[left]))
                for row in range(0, len(rows["node"]), step):
                    met.append(_meet(bucket, {name: x[row : row + step] for name, x in rows.items()}, k == 0, known[left], distance, wide, percent, emit))
            node, count, partner, more = (np.concatenate(x) for x in zip(*met))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(partner))
            yield pa.RecordBatch.from_arrays([pa.array(node), lists, pa.array(more)], names=["a", "held", "more"])

    by_node = dealt.mapInArrow(run, "a long, held array<long>, more boolean").groupBy("a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.max("more").alias("more"))  # `emit` from each bucket that it asks
    return materialise(by_node.select("a", F.slice("held", 1, emit).alias("held"), (F.col("more") | (F.size("held") > emit)).alias("more")), "near")
