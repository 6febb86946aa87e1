"""Token ids by the public tokenizer, and shards of ids as wavelet matrices in files.

A text's ids are those of its words: the tokenizer's pre-tokenizer drops white space and never joins across it, so
each distinct word is encoded once for each worker and looked up afterwards.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, mix, pieces, scratch, utf8, word_hashes

#: Ends each document.
END_ID = 2
#: Stands between words that are encoded together.
MARK = "~"
#: Marks that the tokenizer parts from the letters before them.
TAIL = ".,;:!?|#$%&*"
#: Distinct words that a worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 1_500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after the other."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if total + int(begin.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((begin - (upto - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Memory:
    """What a worker knows of words: sorted 64-bit hashes, a second hash against chance, and where a word's ids stand.

    New words go to a small table, which is merged into the large one when it has grown to an eighth of it. Some 30 bytes a word.
    """

    def __init__(self, width):
        self.tables = [self._empty(), self._empty()]
        self.flat, self.used = np.zeros(1 << 16, width), 0

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, begin, size) for hashes in ascending order."""
        known, begin, size = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, others, begins, sizes in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = (keys[at] == h) & (others[at] == g)
                known |= same
                begin[same], size[same] = begins[at[same]], sizes[at[same]]
        return known, begin, size

    def add(self, h: np.ndarray, g: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Store words; returns where their ids begin."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.tables[1] = self._merged(self.tables[1], (h, g, begin, size.astype(np.int32)))
        if len(self.tables[1][0]) * 8 > len(self.tables[0][0]):
            self.tables = [self._merged(*self.tables), self._empty()]
        return begin

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each string."""
    data, offsets = utf8(words)
    h = word_hashes(data, offsets[:-1], offsets[1:])
    turned = data ^ np.uint8(0x5A)
    return h, mix(word_hashes(turned, offsets[:-1], offsets[1:]) ^ np.uint64(0x9E3779B97F4A7C15))


def _capital_marks(texts: pa.Array) -> bool:
    """Whether a capital stands before what may be a combining mark: the two compose before the tokenizer lowers them."""
    data, _ = utf8(texts)
    return bool(((data[1:] >= 0xC6) & (data[:-1] - np.uint8(65) < 26)).any())


class Encoder:
    """Ids of whole texts; remembers the ids of words."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.remembered = remembered
        self.memory = Memory(self.width)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each path and Python worker."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes. Words are joined with a mark that always is a token of its own; words that hold it are encoded singly."""
        flats, sizes = [np.zeros(0, self.width)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            odd = [i for i, w in enumerate(part) if MARK in w or "<|" in w]
            plain = [part[i] for i in sorted(set(range(len(part))).difference(odd))] if odd else part
            flat = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(plain)], add_special_tokens=False)[0].ids, self.width)
            cut = np.flatnonzero(flat == self.mark)
            if len(plain) and len(cut) != len(plain) - 1:
                raise ValueError("the mark is not a token of its own")
            size = np.diff(cut, prepend=-1, append=len(flat)) - 1 if len(plain) else np.zeros(0, np.int64)
            flat = np.delete(flat, cut)
            if odd:
                alone = [np.array(self.tokenizer.encode(part[i], add_special_tokens=False).ids, self.width) for i in odd]
                where = np.insert(np.arange(len(plain)), [i - n for n, i in enumerate(odd)], np.arange(len(plain), len(part)))
                flat = np.concatenate([flat, *alone])
                all_sizes = np.concatenate([size, [len(x) for x in alone]]).astype(np.int64)
                flat, size = flat[gather((np.cumsum(all_sizes) - all_sizes)[where], all_sizes[where])], all_sizes[where]
            flats.append(flat)
            sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)

    def _known(self, words: pa.Array, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) in the memory of distinct words, learnt where they are new.

        New words that end in marks after a letter a-z or A-Z are put together from the two parts, which are learnt first.
        """
        h, g = hashes(words)
        order = np.argsort(h, kind="stable")
        known, begin, size = self.memory.find(h[order], g[order])
        if not known.all():
            new = order[~known]
            texts = words.take(pa.array(new)).to_pylist()
            if whole:
                begin[~known], size[~known] = self._parts(texts, h[new], g[new])
            else:
                flat, size[~known] = self._ids(texts)
                begin[~known] = self.memory.add(h[new], g[new], flat, size[~known])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return begin[back], size[back]

    def _parts(self, texts: list[str], h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of new words by way of their parts."""
        first, last = [], []
        for w in texts:
            core = w.rstrip(TAIL)
            if core and len(core) < len(w) and core[-1].isascii() and core[-1].isalpha():  # others may lower to more than a letter
                first.append(core.lower() if core.isascii() else core)
                last.append(w[len(core) :])
            else:
                first.append(w)
                last.append("")
        coded = pa.array(first + last, pa.large_string()).dictionary_encode()
        begin, size = self._known(coded.dictionary, whole=False)
        code = np.asarray(coded.indices)
        begin, size = begin[code].reshape(2, -1), size[code].reshape(2, -1)
        out, total = begin[0], size.sum(0)
        two = np.flatnonzero(size[1])
        if len(two):
            flat = self.memory.flat[gather(begin.T[two].ravel(), size.T[two].ravel())]
            out[two] = self.memory.add(h[two], g[two], flat, total[two])
        return out, total

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id last, and where each text begins (one more than texts)."""
        texts = pc.fill_null(texts, "")
        lower = not pc.any(pc.match_substring(texts, "<|")).as_py()  # else a special token could come about
        plain = lower and not _capital_marks(texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        first = np.asarray(split.offsets)
        words = split.flatten()
        if lower and not plain:
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        coded = words.dictionary_encode()
        if len(self.memory) > self.remembered:
            self.memory = Memory(self.width)
        begin, size = self._known(coded.dictionary)
        which = np.asarray(coded.indices)
        sizes = size[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = upto[first - first[0]] + np.arange(len(first))
        flat = np.full(bounds[-1], end_id, self.width)
        body = np.ones(len(flat), bool)
        body[bounds[1:] - 1] = False
        flat[body] = self.memory.flat[gather(begin[which], sizes)]
        return flat, bounds


def encoded(batches, path: str):
    """(doc_ids, flat ids, bounds) for pieces of the batches (doc_id, text)."""
    encoder = Encoder.of(path)
    for batch in batches:
        for part in pieces(batch, "text", 2 << 20):
            yield part.column("doc_id").to_pylist(), *encoder.encode(part.column("text"))
        pa.default_memory_pool().release_unused()


class WaveletMatrix:
    """Bit-planes of a sequence, highest bit first; after each plane zeros precede ones, in stable order.

    A rank directory (ones before each 512 bits) makes rank a popcount of one block; select searches the directory.
    """

    BLOCK = 512

    def __init__(self, length: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.length, self.planes, self.zeros, self.ranks = length, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        a = ids
        for level in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            short = -len(packed) % (cls.BLOCK // 8)
            packed = np.concatenate([packed, np.zeros(short, np.uint8)]) if short else packed
            ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, cls.BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            planes.append(packed)
            mask = pa.Array.from_buffers(pa.bool_(), len(a), [None, pa.py_buffer(packed)])
            zero, rest = (pc.filter(pa.array(a), m).to_numpy() for m in (pc.invert(mask), mask))
            zeros.append(len(zero))
            a = np.concatenate([zero, rest])
        return cls(len(ids), planes, zeros, ranks)

    def decode(self) -> np.ndarray:
        """All values in order, from the lowest plane upwards."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        a = np.zeros(self.length, kind)
        for depth, (packed, zero) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(packed, count=self.length, bitorder="little").view(bool)
            out = np.empty_like(a)
            np.place(out, ~one, a[:zero])
            np.place(out, one, a[zero:] | kind(1 << depth))
            a = out
        return a

    def _ones(self, plane: int, i: int) -> int:
        block = i // self.BLOCK
        begin = block * self.BLOCK // 8
        part = np.unpackbits(self.planes[plane][begin : begin + self.BLOCK // 8], bitorder="little")[: i % self.BLOCK]
        return int(self.ranks[plane][block]) + int(part.sum())

    def access(self, i: int) -> int:
        value = 0
        for p, zero in enumerate(self.zeros):
            one = self.planes[p][i >> 3] >> (i & 7) & 1
            value = value << 1 | int(one)
            i = zero + self._ones(p, i) if one else i - self._ones(p, i)
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        begin, end = 0, i
        for p, zero in enumerate(self.zeros):
            one = symbol >> (len(self.zeros) - 1 - p) & 1
            begin, end = (zero + self._ones(p, x) if one else x - self._ones(p, x) for x in (begin, end))
        return begin, end

    def rank(self, symbol: int, i: int) -> int:
        """How often a symbol is among the first i."""
        if symbol >> len(self.zeros):
            return 0
        begin, end = self._range(symbol, i)
        return end - begin

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.length)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        i = self._range(symbol, self.length)[0] + k
        for p in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        before = self.ranks[plane].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * self.BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        begin = block * self.BLOCK // 8
        part = np.unpackbits(self.planes[plane][begin : begin + self.BLOCK // 8], bitorder="little")
        return block * self.BLOCK + int(np.flatnonzero(part == one)[k - int(before[block])])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


MAGIC = b"WMX1"


def shard_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One file: magic, a JSON header with its size before it, then doc ids, sizes, and each plane with its rank directory."""
    matrix = WaveletMatrix.build(ids, bits)
    header = json.dumps({"docs": len(doc_ids), "tokens": matrix.length, "bits": bits, "zeros": matrix.zeros, "null_ids": [i for i, x in enumerate(doc_ids) if x is None]}).encode()
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<I", len(header)) + header)
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes())
    for plane, rank in zip(matrix.planes, matrix.ranks):
        out.write(plane.tobytes() + rank.astype("<u4").tobytes())
    return out.getvalue()


def read_shard(raw: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Doc ids, ids of each, and the matrix."""
    if raw[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    at = 8 + struct.unpack_from("<I", raw, 4)[0]
    head = json.loads(raw[8:at])
    docs, tokens = head["docs"], head["tokens"]
    doc_ids: list = np.frombuffer(raw, "<i8", docs, at).tolist()
    for i in head["null_ids"]:
        doc_ids[i] = None
    sizes = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    blocks = -(-tokens // WaveletMatrix.BLOCK)
    planes, ranks = [], []
    for _ in range(head["bits"]):
        planes.append(np.frombuffer(raw, np.uint8, blocks * WaveletMatrix.BLOCK // 8, at))
        at += blocks * WaveletMatrix.BLOCK // 8
        ranks.append(np.frombuffer(raw, "<u4", blocks + 1, at))
        at += 4 * (blocks + 1)
    return doc_ids, sizes, WaveletMatrix(tokens, planes, head["zeros"], ranks)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, out: str, path: str, shard_tokens: int = 2_000_000, end_id: int = END_ID) -> DataFrame:
    """Write ids of `docs` (doc_id, text) in ascending doc_id order; return the manifest (part, shard, path, docs, tokens, base).

    A task holds one range of doc ids, in order, and starts a new file at the first document past `shard_tokens`.
    Names follow from the range alone and a file appears under its name only when whole, so a task that runs again
    leaves the same files. Null text is empty; null doc_id sorts first; an empty table writes no file. `base` is the number of
    ids before the shard: totals of the ranges (a row for each) are summed on the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = bounded(docs).select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = _filesystem(out)
        fs.create_dir(root, recursive=True)
        bits = max(1, (Encoder.of(path).tokenizer.get_vocab_size() - 1).bit_length(), end_id.bit_length())
        held: list = []
        rows: list = []

        def flush():
            if held:
                sizes = [len(x) for _, x in held]
                raw = shard_bytes([d for d, _ in held], sizes, np.concatenate([x for _, x in held]), bits)
                name = f"{root}/part-{part:06d}-{len(rows):06d}.wmx"
                draft = f"{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(raw)
                fs.move(draft, name)
                rows.append((part, len(rows), f"{out}/{name.rsplit('/', 1)[1]}", len(held), sum(sizes)))
                held.clear()

        size = 0
        for doc_ids, flat, bounds in encoded(batches, path):
            for i, d in enumerate(doc_ids):
                ids = flat[bounds[i] : bounds[i + 1]]
                if size and size + len(ids) > shard_tokens:
                    flush()
                    size = 0
                held.append((d, ids))
                size += len(ids)
        flush()
        columns = list(zip(*rows)) or [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "shard", "path", "docs", "tokens"])

    manifest = materialise(ranged.mapInArrow(write, "part int, shard int, path string, docs long, tokens long"), "manifest")
    base, bases = 0, []
    for part, tokens in sorted(manifest.groupBy("part").agg(F.sum("tokens")).collect()):  # a row for each range
        bases.append((part, base))
        base += tokens
    known = spark.createDataFrame(bases, "part int, base_part long")
    from pyspark.sql import Window

    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(F.broadcast(known), "part").withColumn("base", F.col("base_part") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("base_part")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) from the files; ids are little-endian unsigned 32-bit integers."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = _filesystem(path)
                with fs.open_input_stream(name) as f:
                    doc_ids, sizes, matrix = read_shard(f.read())
                ids, end = matrix.decode(), np.cumsum(sizes)
                for at in range(0, len(doc_ids), 256):
                    to = min(at + 256, len(doc_ids))
                    wide = ids[end[at] - sizes[at] : end[to - 1]].astype("<u4")
                    bounds = np.concatenate([[0], np.cumsum(sizes[at:to])]) * 4
                    blob = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(wide)])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(base + end[at:to] - sizes[at:to], pa.int64()), blob], names=["doc_id", "start", "ids"])

    spread = manifest.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, out: str | None = None, shard_tokens: int = 2_000_000) -> DataFrame:
    """Write the shards (to the shared folder unless `out` says otherwise) and read them back."""
    return read_shards(write_shards(docs, out or scratch(docs.sparkSession, "tokens"), path or tokenizer_path(), shard_tokens))
