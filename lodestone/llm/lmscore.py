"""Marginal likelihood of texts over all segmentations into subwords, and a word-unigram base.

The pieces come from a public vocabulary; their scores are re-estimated from the training part by counting the vocabulary's
own segmentation of it. A word's probability is the sum over all segmentations of the product of piece probabilities, by a forward recursion
in log space; characters outside the vocabulary go through its byte pieces. Pieces never cross words, so a text's log probability
is the sum over its words and one end token.

Texts are never shuffled. A task cuts its documents into blocks, writes each document as counts over the block's sorted
words, and each block's distinct words with their training counts. Words then meet across blocks (a row for each block, so
that no word is hot), each distinct word is scored once, and the scores return to their blocks.

Null and empty texts are the end token alone. Rows without doc_id train and are never held out. With no training rows all counts are zero and
pieces are equally likely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, crc_remainder, materialise, pieces

#: Text bytes in a block; bounds what one task holds. A longer document is a block of its own.
BLOCK_BYTES = 8 << 20
MARK = "▁"
LOG10 = math.log(10)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_processors: dict = {}


def processor(path: str):
    if path not in _processors:
        import sentencepiece

        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


class Lattice:
    """Log probabilities of words under piece log probabilities (natural logarithms)."""

    def __init__(self, path: str, weights: np.ndarray):
        sp = processor(path)
        size = sp.get_piece_size()
        self.bytes = [0.0] * 256
        self.known: dict[str, float | None] = {}
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = float(weights[i])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.known[sp.id_to_piece(i)] = float(weights[i])
        for piece in list(self.known):
            for end in range(1, len(piece)):
                self.known.setdefault(piece[:end], None)  # a prefix alone

    def log_prob(self, word: str) -> float:
        text = MARK + word
        n, known = len(text), self.known
        inward: list[list[float]] = [[] for _ in range(n + 1)]
        inward[0].append(0.0)
        for i in range(n):
            terms = inward[i]
            if not terms:
                continue
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + math.log(sum([math.exp(t - top) for t in terms]))
            inward[i] = []
            j = i + 1
            while j <= n:
                value = known.get(text[i:j], 0)  # 0: neither a piece nor the beginning of one
                if value == 0:
                    break
                if value is not None:
                    inward[j].append(here + value)
                j += 1
            if known.get(text[i]) is None:
                inward[i + 1].append(here + sum(self.bytes[b] for b in text[i].encode("utf-8", "replace")))
        terms = inward[n]
        top = max(terms)
        return top + math.log(sum([math.exp(t - top) for t in terms]))


GATHERED = "kind int, block long, doc_id long, held_out boolean, n_tokens long, counts binary, word string, place int, n long"


def _gather_block(part: pa.RecordBatch, block: int, sp) -> pa.RecordBatch:
    """Rows of a block: documents (kind 0), distinct words (1), piece counts (2; place is the piece)."""
    rows = len(part)
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column("text"), "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    order = np.asarray(pc.sort_indices(words))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = words.take(pa.array(order))
    code = rank[np.asarray(coded.indices)]
    lengths = np.diff(np.asarray(split.offsets))
    doc = np.repeat(np.arange(rows), lengths)
    if len(words) and words[0].as_py() == "":  # what splitting leaves at the ends of a text
        real = code > 0
        doc, code, words = doc[real], code[real] - 1, words.slice(1)
    size = max(len(words), 1)
    del split, coded, rank
    doc *= size
    doc += code
    del code
    key, times = np.unique(doc, return_counts=True)
    del doc
    of, place = key // size, key % size
    del key
    cut = np.searchsorted(of, np.arange(rows + 1))
    held = np.asarray(part.column("held_out"))
    steps = np.diff(place, prepend=0)
    first = cut[:-1][cut[:-1] < cut[1:]]
    steps[first] = place[first]
    steps, small = steps.astype("<i4"), times.astype("<i4")
    counts = [pa.compress(steps[a:b].tobytes() + small[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(cut[:-1], cut[1:])]
    trained = np.bincount(place, times * ~held[of], len(words)).astype(np.int64)
    used = np.zeros(sp.get_piece_size(), np.int64)
    for at in range(0, len(words), 20_000):
        ids = sp.encode(words.slice(at, 20_000).to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, sizes.sum())
        used += np.bincount(flat, np.repeat(trained[at : at + 20_000], sizes), len(used)).astype(np.int64)
    pieces_used = np.flatnonzero(used)
    n = (rows, len(words), len(pieces_used))
    total = sum(n)

    def column(values, at: int, kind):
        before, after = sum(n[:at]), total - sum(n[: at + 1])
        return pa.concat_arrays([pa.nulls(before, kind), values.cast(kind), pa.nulls(after, kind)])

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([0, 1, 2], n), pa.int32()),
            pa.array(np.full(total, block)),
            column(part.column("doc_id"), 0, pa.int64()),
            column(part.column("held_out"), 0, pa.bool_()),
            column(pa.array(np.bincount(of, times, rows).astype(np.int64) + 1), 0, pa.int64()),
            column(pa.array(counts, pa.binary()), 0, pa.binary()),
            column(words, 1, pa.string()),
            pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(np.arange(len(words)), pa.int32()), pa.array(pieces_used, pa.int32())]),
            pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(trained), pa.array(used[pieces_used])]),
        ],
        names=[x.split()[0] for x in GATHERED.split(", ")],
    )


def gather(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        sp, block, held, size = processor(path), TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield _gather_block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], block, sp)
                    block, held, size = block + 1, [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield _gather_block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], block, sp)

    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text", F.coalesce(crc_remainder(7) == 2, F.lit(False)).alias("held_out")).mapInArrow(run, GATHERED)
    return materialise(rows, "gathered")


def piece_weights(gathered: DataFrame, path: str, documents: int) -> tuple[np.ndarray, float]:
    """Log probabilities of all pieces and of the end token, from training counts with half a count added; a row for each piece comes to the driver."""
    counts = np.full(processor(path).get_piece_size(), 0.5)
    for row in gathered.where("kind = 2").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[row.place] += row.n
    total = math.log(counts.sum() + documents + 0.5)
    return np.log(counts) - total, math.log(documents + 0.5) - total


def score_words(gathered: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(block, place, n, log_prob, first): for each block's words the training count and log10 probability; first marks one row of each word."""
    spark = gathered.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # a float for each piece of the vocabulary

    def run(batches):
        lattice = Lattice(path, shared.value)
        waiting: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            words = rows.column("word").combine_chunks()
            coded = words.dictionary_encode() if len(words) else None
            if coded is None:
                return None
            code = np.asarray(coded.indices)
            begin = np.flatnonzero(np.diff(code, prepend=-1))
            n = np.add.reduceat(rows.column("n").to_numpy(), begin)
            lp = np.array([lattice.log_prob(w) for w in coded.dictionary.to_pylist()]) / LOG10
            first = np.zeros(len(code), bool)
            first[begin] = True
            return pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), rows.column("place").combine_chunks(), pa.array(n[code]), pa.array(lp[code]), pa.array(first)], names=["block", "place", "n", "log_prob", "first"])

        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            last = table.column("word")[-1]
            if batch.column("word")[0] == last:  # one word through and through: it may go on
                continue
            same = pc.index(table.column("word"), last).as_py()  # rows are in the words' order
            yield flush(table.slice(0, same))
            waiting = table.slice(same).combine_chunks().to_batches()
        if waiting:
            yield flush(pa.Table.from_batches(waiting))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = gathered.where("kind = 1").select("word", "block", "place", "n").repartition(parts, "word").sortWithinPartitions("word")
    return materialise(ordered.mapInArrow(run, "block long, place int, n long, log_prob double, first boolean"), "words")


def log_likelihood(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text)."""
    path = path or vocabulary_path()
    gathered = gather(docs, path)
    trained = gathered.where("kind = 0 and not held_out").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    weights, end = piece_weights(gathered, path, trained.docs)
    words = score_words(gathered, path, weights)
    distinct = words.where("first and n > 0").count() + (trained.docs > 0)
    whole, ends, tokens = math.log10(trained.tokens + distinct + 1), trained.docs, trained.tokens
    end_score = end / LOG10

    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        n, lp = np.zeros(len(place), np.int64), np.zeros(len(place))
        n[place], lp[place] = found.column("n").to_numpy(), found.column("log_prob").to_numpy()
        seen = np.log10(n + 1)
        rows = []
        for raw, size in zip(texts.column("counts").to_pylist(), texts.column("n_tokens").to_pylist()):
            data = np.frombuffer(pa.decompress(raw, _content_size(raw), "zstd", asbytes=True), "<i4")
            at, times = np.cumsum(data[: len(data) // 2]), data[len(data) // 2 :]
            rows.append((int(times @ (n[at] > 0)) + (ends > 0), float(times @ seen[at]) + math.log10(ends + 1) - size * whole, float(times @ lp[at]) + end_score))
        known, base, score = zip(*rows)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("n_tokens"), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(rows), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    texts = gathered.where("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "counts")
    return texts.groupBy("block").cogroup(words.select("block", "place", "n", "log_prob").groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _content_size(raw: bytes) -> int:
    """Size before compression, from the frame's header."""
    import zstandard

    return zstandard.frame_content_size(raw)
