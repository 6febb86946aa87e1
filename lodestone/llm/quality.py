"""Quality score by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_j x_j + 1/2 sum_f ((sum v_jf x_j)^2 - sum v_jf^2 x_j^2)), linear in the features that a text has.
Words carry a damped count, scaled to unit length for each text; statistics fall into levels, each a feature of value one, so
that pairs of levels interact. Metadata is the table's n_chars, null being a level of its own.

Null and empty texts have statistics only and get a score. Labels join by doc_id and serve training alone; repeated labels
of a document are averaged to the majority (ties: 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, crc_remainder, mix, pieces, utf8, word_bounds, word_hashes

BUCKETS = 1 << 16
LEVELS = 16
#: Statistics of a text, each in LEVELS levels: see `statistics`.
STATS = ("chars", "words", "word_size", "upper", "digits", "marks", "symbols", "bangs", "pipes", "lines", "distinct", "top_word", "dup_lines", "wide", "n_chars")
WIDTH = BUCKETS + len(STATS) * LEVELS


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars.encode())] = 1
    return table


_COUNTED = [_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:?!'\"()-"), _class("#*$%&<>~^{}[]\\="), _class("!"), _class("|")]


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) triples, by row, of a batch (text, n_chars)."""
    rows = len(batch)
    data, offsets = utf8(batch.column("text"))
    starts, ends, first = word_bounds(data, offsets)
    count, size = np.diff(first), np.diff(offsets)
    of = np.repeat(np.arange(rows), count)
    key, times = np.unique(of * BUCKETS + (word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(row, value**2, rows))[row]

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    whole, words = np.maximum(size, 1), np.maximum(count, 1)
    shares = [total(table[data]) / whole for table in _COUNTED]
    marks = data == 10
    line_start = np.union1d(offsets[:-1][size > 0], np.flatnonzero(marks) + 1)
    line_start = line_start[line_start < len(data)]
    line_of = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_of + 1]) if len(line_start) else line_start
    lines = np.bincount(line_of, minlength=rows)
    once = np.unique(mix(word_hashes(data, line_start, line_end) + line_of.astype(np.uint64)), return_index=True)[1] if len(line_start) else []
    distinct_lines = np.bincount(line_of[once], minlength=rows) if len(line_start) else lines
    distinct = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, times)
    said = batch.column("n_chars").cast(pa.float64())
    known = ~np.asarray(said.is_null())
    meta = np.where(known, np.log2(1 + np.maximum(np.nan_to_num(np.asarray(said.to_numpy(zero_copy_only=False))), 0)), LEVELS - 1)
    in_words = np.bincount(of, ends - starts, rows)
    share = lambda x: np.sqrt(np.clip(x, 0, 1)) * LEVELS
    stats = [np.log2(1 + size), np.log2(1 + count), in_words / words, *map(share, shares), share(lines / words), share(distinct / words), share(top / words), share(1 - distinct_lines / np.maximum(lines, 1)), share(total(data >= 128) / whole), meta]
    levels = np.stack([np.clip(x, 0, LEVELS - 1).astype(np.int64) for x in stats], 1) + BUCKETS + np.arange(len(STATS)) * LEVELS
    row = np.concatenate([row, np.repeat(np.arange(rows), len(STATS))])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([bucket, levels.ravel()])[order], np.concatenate([value, np.ones(levels.size)])[order]


@dataclass
class Machine:
    """Weights; 65,776 features of rank 8 are 2.4 MB, whatever the corpus."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """One for each row; each row has features and rows are together."""
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        pulled = self.factors[feature] * value[:, None]
        pairs = np.add.reduceat(pulled, begin) ** 2 - np.add.reduceat(pulled**2, begin)
        return self.bias + np.add.reduceat(self.linear[feature] * value, begin) + 0.5 * pairs.sum(1)


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; both labels weigh as they occur."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH, np.float64), rng.normal(0, 0.02, (WIDTH, rank)))
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-2), np.full((WIDTH, rank), 1e-2), 1e-2
    bounds = np.searchsorted(row, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            size = bounds[chosen + 1] - bounds[chosen]
            where = np.repeat(bounds[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            local, x = np.repeat(np.arange(len(chosen)), size), value[where]
            used, j = np.unique(feature[where], return_inverse=True)
            w, v = machine.linear[used], machine.factors[used]
            begin = np.cumsum(size) - size
            pulled = v[j] * x[:, None]
            sums = np.add.reduceat(pulled, begin)
            z = machine.bias + np.add.reduceat(w[j] * x, begin) + 0.5 * (sums**2 - np.add.reduceat(pulled**2, begin)).sum(1)
            error = (1 / (1 + np.exp(-z)) - label[chosen]) / len(chosen)
            gx = error[local] * x
            gw = np.bincount(j, gx, len(used)) + decay * w
            part = gx[:, None] * (sums[local] - pulled)
            gv = np.stack([np.bincount(j, part[:, f], len(used)) for f in range(rank)], 1) + decay * v
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += error.sum() ** 2
            machine.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            machine.bias -= rate * error.sum() / np.sqrt(seen_b)
    return machine


def _said(docs: DataFrame):
    """The table's own count of characters."""
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Machine:
    """Fit on labelled rows outside the held-out fifth; a table without n_chars has it unknown.

    `max_rows` bounds the sample: the labelled rows with the smallest hash of doc_id, read whole. Their ids (at most max_rows
    longs) are broadcast, their features come to the driver.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = chosen.where(crc_remainder(5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, feature, value = features(part)
                bounds = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                blobs = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds * 4), pa.py_buffer(np.ascontiguousarray(x))]) for x in (feature.astype("<i4"), value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *blobs], names=["doc_id", "label", "feature", "value"])

    found = bounded(docs).select("doc_id", "text", _said(docs)).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, label int, feature binary, value binary")
    got = sorted(found.collect(), key=lambda x: (x.doc_id, x.feature, x.value))
    sizes = [len(x.feature) // 4 for x in got]
    feature = np.frombuffer(b"".join(x.feature for x in got), "<i4")
    value = np.frombuffer(b"".join(x.value for x in got), "<f4").astype(np.float64)
    return fit(np.repeat(np.arange(len(got)), sizes), feature, value, np.array([x.label for x in got], np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score) for each row of `docs` (doc_id, text, n_chars); others are not read, and equal rows score alike."""
    weights = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    def run(batches):
        own = Machine(*weights.value)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                z = own.logits(*features(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "held_out", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long"), (F.coalesce(crc_remainder(5), F.lit(1)) == 0).alias("held_out"), "text", _said(docs)).mapInArrow(run, "doc_id long, held_out boolean, score double")
