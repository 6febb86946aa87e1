"""What several operators share: the shared folder, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one on a single machine where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one struct, where no name can clash with an operator's own."""
    others = [docs[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("_others"))


def wide(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in docs.columns))


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """`docs`, in a session whose Arrow batches hold BATCH_BYTES at most: texts are long, and both ends buffer whole batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", docs.sparkSession.conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        docs.sparkSession.conf.set(key, str(BATCH_BYTES))
    return docs


#: Rows, and bytes as text, up to which a measured side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is measured and small; `df` should be stored or cheap."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes")).first()
    return F.broadcast(df) if size.rows <= rows and (size.bytes or 0) <= BROADCAST_BYTES else df


def crc_remainder(divisor: int, doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo divisor."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if bounds else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return raw[first : int(offsets[-1])], offsets - first


def pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Slices of a batch with about `limit` bytes of text each, so that temporary arrays stay small; at least a row each."""
    _, offsets = utf8(batch.column(text))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


#: U+0009 to U+000D and U+0020 separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of texts, and the first word of each text (one more than texts)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=inside[:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    begins[inner] = inside[inner]
    stops = inside[:-1].copy()
    stops &= ~inside[1:]
    stops[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time over all ranges at once."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix((mix(size.astype(np.uint64) + _GOLD) ^ (lanes[starts] & _KEEP[np.minimum(size, 8)])) * _GOLD + _M1)
    live, done = np.flatnonzero(size > 8), 8
    while len(live):
        h[live] = mix((h[live] ^ (lanes[starts[live] + done] & _KEEP[np.minimum(size[live] - done, 8)])) * _GOLD + _M1)
        done += 8
        live = live[size[live] > done]
    return h


class Rolling:
    """Hashes of ranges of a sequence of 64-bit values, each in constant time."""

    _base, _inverse = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Rolling._powers) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("_powers", self._base), ("_inverses", self._inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Rolling._powers[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * Rolling._inverses[begin] ^ (end - begin).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def split_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes; bytes.split() cuts at exactly these six."""
    return text.split()
