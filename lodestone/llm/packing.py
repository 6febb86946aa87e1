"""Harmonic packing of token ids into sequences.

A document is cut into full sequences and a rest. Rests fall into classes by reciprocals of the capacity: class k holds lengths over
capacity / (k + 1), up to capacity / k. A sequence of class k takes k whole pieces and the head of one more, which fills it; what
is left of that one is a piece of its own, in its own class. So each sequence of a class holds the same number of pieces, k + 1
(k, if they fill it exactly), and no padding. The last class takes all shorter pieces, as many as fill a sequence.

Each task fills the sequences of its own documents. Pieces that wait when a task ends, fewer than k + 1 of each class,
meet those of 64 other tasks, and so on until one task has the rest: at most 64 times `classes` sequences. What waits there
in the end, less than `classes` sequences whatever the corpus, is laid end to end and cut into powers of two, which
need no padding; these pieces have class 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise
from lodestone.llm.tokens import encoded, tokenizer_path

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, size_class int, ids binary"
#: Tasks whose waiting pieces meet in one.
MEET = 64
#: A piece: document, its first id's place there, its ids, ids of the document.
Piece = tuple[int, int, np.ndarray, int]


def size_class(length: int, capacity: int, classes: int) -> int:
    """k with capacity / (k + 1) < length <= capacity / k, `classes` at most."""
    return min(capacity // length, classes)


class Packer:
    """Open sequences of one task: for each class the pieces that wait, never a full sequence's worth."""

    def __init__(self, first: int, capacity: int, classes: int):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list[Piece]] = {}
        self.filled: dict[int, int] = {}
        self.done: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.capacity:
                self._close([(doc_id, start, ids[: self.capacity], total)], 1)
                start, ids = start + self.capacity, ids[self.capacity :]
                continue
            k = size_class(len(ids), self.capacity, self.classes)
            held = self.open.setdefault(k, [])
            take = min(len(ids), self.capacity - self.filled.get(k, 0))
            held.append((doc_id, start, ids[:take].copy(), total))  # pieces that wait must not hold the batch
            self.filled[k] = self.filled.get(k, 0) + take
            if self.filled[k] == self.capacity:
                self._close(self.open.pop(k), k)
                self.filled[k] = 0
            start, ids = start + take, ids[take:]

    def _close(self, held: list[Piece], k: int) -> None:
        offset = 0
        for doc_id, start, ids, total in held:
            self.done.append((doc_id, start, len(ids), total, self.next, offset, k, ids))
            offset += len(ids)
        self.next += 1

    def waiting(self) -> list[Piece]:
        return [piece for k in sorted(self.open) for piece in self.open[k]]

    def leave(self) -> None:
        """Give what waits without a sequence."""
        self.done += [(d, start, len(ids), total, None, None, 0, ids) for d, start, ids, total in self.waiting()]
        self.open = {}

    def finish(self) -> None:
        """Close what waits, long pieces first: full sequences, then powers of two."""
        waiting = sorted(self.waiting(), key=lambda piece: -len(piece[2]))
        left = sum(len(p[2]) for p in waiting)
        room, held = 0, []
        for doc_id, start, ids, total in waiting:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) - at)
                held.append((doc_id, start + at, ids[at : at + take], total))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self._close(held, 0)
                    held = []
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        *columns, ids = list(zip(*self.done)) or [()] * 8
        self.done = []
        blobs = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
        kinds = [pa.int64()] * 6 + [pa.int32()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), blobs], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _first(level: int) -> int:
    """Ids for the sequences of this task: the level and the task are in the upper bits."""
    from pyspark import TaskContext

    return (level << 58) + (TaskContext.get().partitionId() << 36)


def _merge(waiting: DataFrame, level: int, groups: int, capacity: int, classes: int) -> DataFrame:
    """Pack pieces that wait; those of a group in one task. With one group nothing waits any more."""
    columns = ["task", "doc_id", "start", "doc_tokens", "ids"]
    rows = waiting.select(F.pmod("task", F.lit(groups)).alias("slot"), *columns)
    rows = (rows.repartition(groups, "slot") if groups > 1 else rows.repartition(1)).sortWithinPartitions(*columns[:3])

    def run(batches):
        packer = Packer(_first(level), capacity, classes)
        for batch in batches:
            for d, start, total, ids in zip(*(batch.column(c).to_pylist() for c in columns[1:])):
                packer.add(d, start, np.frombuffer(ids, "<u4"), total)
            if packer.done:
                yield packer.batch()
        packer.finish() if groups == 1 else packer.leave()
        yield packer.batch()

    return rows.mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, classes: int = 16) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are not read): place, sequence and ids (little-endian unsigned 32-bit).

    Null or empty text is the end id alone. Null and repeated doc_ids are packed as rows of their own, also if texts are equal. An empty
    table gives no piece. Sequence ids are unique.
    """
    path = path or tokenizer_path()

    def run(batches):
        packer = Packer(_first(0), capacity, classes)
        for doc_ids, flat, bounds in encoded(batches, path):
            for i, d in enumerate(doc_ids):
                ids = flat[bounds[i] : bounds[i + 1]]
                packer.add(d, 0, ids, len(ids))
            if packer.done:
                yield packer.batch()
        packer.leave()
        yield packer.batch()

    level, task, out = 0, F.spark_partition_id().alias("task"), []
    packed = bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
    while True:
        table = materialise(packed.select("*", task), "packed")
        out.append(table.where("sequence_id is not null").drop("task"))
        waiting = table.where("sequence_id is null")
        tasks = waiting.agg(F.count_distinct("task")).first()[0]
        if not tasks:
            break
        level += 1
        packed = _merge(waiting, level, -(-tasks // MEET), capacity, classes)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole
