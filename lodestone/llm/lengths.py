"""Token counts of whole texts by a public tokenizer.

Texts go to the tokenizer in batches of about equal bytes and only lengths come back. Long texts are cut where the
tokenizer never joins: before a blank between an ASCII letter, digit or full stop and an ASCII letter or digit. The counts
of the parts add up to that of the whole. A text without such a place stays whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, pieces
from lodestone.llm.tokens import tokenizer_path

#: Bytes of a part of a long text, and of what goes to the tokenizer at once.
PART_BYTES, BATCH_BYTES = 1 << 16, 1 << 20
_CUT = re.compile(rb"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def parts_of(text: bytes, most: int, keep_blank: bool) -> list[bytes]:
    """The text in parts of `most` bytes, each as much longer as the next safe place is away; the blank begins the next part or goes."""
    out, begin = [], 0
    while len(text) - begin > most:
        found = _CUT.search(text, begin + most)
        if not found:
            break
        out.append(text[begin : found.start()])
        begin = found.start() + (not keep_blank)
    return [*out, text[begin:]]


class Counter:
    """Numbers of tokens of texts by one tokenizer file: the tokenizers library for .json, sentencepiece for .model."""

    _by_path: dict[str, Counter] = {}

    def __init__(self, path: str):
        pieces = path.endswith(".model")
        self.keep_blank = not pieces
        self.whole = False  # whether texts must not be cut
        self._count = self._pieces(path) if pieces else self._tokens(path)

    @classmethod
    def of(cls, path: str) -> Counter:
        """One for each path and Python worker."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _tokens(self, path: str) -> Callable[[list[str]], list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        count = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.whole = not self._parts_add_up(count)
        return count

    def _pieces(self, path: str) -> Callable[[list[str]], list[int]]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        self.whole = inner or not self._parts_add_up(count)
        return count

    def _parts_add_up(self, count: Callable[[list[str]], list[int]]) -> bool:
        """Whether blanks are handled as the cuts need it; a tokenizer that marks the start of a text otherwise gets texts whole."""
        sample = b"One two, three 4 five. six 78 nine"
        parts = parts_of(sample, 1, self.keep_blank)
        return len(parts) > 4 and sum(count([p.decode() for p in parts])) == count([sample.decode()])[0]

    def count(self, texts: list[bytes], part_bytes: int = PART_BYTES, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
        """Tokens of each text."""
        total, held, owner, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal size
            if held:
                np.add.at(total, owner, self._count(held))
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in [text] if self.whole or len(text) <= part_bytes else parts_of(text, part_bytes, self.keep_blank):
                if size + len(part) > batch_bytes:
                    flush()
                held.append(part.decode())
                owner.append(i)
                size += len(part)
        flush()
        return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, part_bytes: int = PART_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text; other columns are not read).

    No begin, end or added special tokens; special strings in a text count as the library takes them; nothing is cut off or padded. Null text
    is empty and has no bytes and no tokens. Null and repeated doc_ids and repeated texts are rows of their own; an empty table gives no
    rows. Nothing is shuffled: a row is counted where it is read, and tasks hold `batch_bytes` at a time (or one text).
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = Counter.of(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counter.count(texts, part_bytes, batch_bytes))], names=["doc_id", "n_bytes", "n_tokens"])

    counted = bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
