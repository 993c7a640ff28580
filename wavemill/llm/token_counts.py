"""Token counts of whole texts by a public byte-level BPE.

A text is cut wherever one pre-token must end: before ASCII white space that follows a byte which is surely not
white space. Counts of the pieces add up to the count of the text, so long texts need no special path, equal pieces
are encoded once, and only lengths leave the worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import schema_of

#: Texts of a slice, in bytes; pieces whose counts a worker remembers.
SLICE_BYTES, REMEMBERED = 4 << 20, 1 << 20
_SPACE = ~K.NOT_SPACE


def safe_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Piece starts: row starts, and white space behind a byte that ends a visible ASCII character, a two-byte
    character from U+00C0 on or a three-byte one from U+4000 on (none of which is white space)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    solid = (buf >= 0x21) & (buf <= 0x7E)
    tail = buf >= 0x80
    solid[1:] |= tail[1:] & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
    solid[2:] |= tail[2:] & (buf[:-2] >= 0xE4) & (buf[:-2] <= 0xEF)
    cut = np.zeros(n, bool)
    cut[1:] = _SPACE[buf[1:]] & solid[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class PieceCounter:
    """Counts tokens of pieces; remembers a bounded number of them by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, first, back = np.unique(K.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        at, known = K.lookup(self.keys, keys)
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        data = buf.tobytes()
        texts = [data[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        counts[new] = [len(x) for x in self.encode(texts, add_special_tokens=False)]
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.counts = keys, counts
        elif len(new):
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return counts[back]


_COUNTERS: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    ``tokenizer`` is the path of a tokenizers JSON file present on every machine. Rows are independent: a null or
    empty text has 0 bytes and 0 tokens, repeated rows repeat in the result, an empty table gives an empty one, a
    null doc_id stays null and other columns are ignored whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, PieceCounter(tokenizer))
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES):
                starts = safe_starts(buf, offsets)
                total = np.zeros(part.num_rows, np.int64)
                if len(starts):
                    counts = counter(buf, starts, np.append(starts[1:], len(buf)))
                    np.add.at(total, np.searchsorted(offsets, starts, "right") - 1, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, schema_of(doc_id=docs.schema["doc_id"].dataType.simpleString(), n_bytes="bigint", n_tokens="bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
