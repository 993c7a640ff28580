"""Sets of 64-bit keys of any size as sorted arrays in the shared folder, memory-mapped by the tasks that ask them.

They thin out large rows before a shuffle join; the join itself decides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import freed_shuffles, mounted, schema_of, scratch


def publish(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays whole or not at all: a task that runs again replaces equal files."""
    os.makedirs(folder, exist_ok=True)
    for k, v in arrays.items():
        part = f"{folder}/.{name}.{k}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, v)
        os.replace(part, f"{folder}/{name}.{k}.npy")


class KeySet:
    """Membership in a published set: bucket b (the first ``bits`` bits of a key) is the file f<b>.key.npy."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.shift, self.maps = folder, np.uint64(64 - bits), {}

    def known(self, keys: np.ndarray) -> np.ndarray:
        every, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(every), bool)
        bucket = (every >> self.shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 62))
        for i, j in zip(cuts[:-1], cuts[1:]):
            b = int(bucket[i])
            if b not in self.maps:
                path = f"{self.folder}/f{b}.key.npy"
                self.maps[b] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
            out[i:j] = K.lookup(self.maps[b], every[i:j])[1]
        return out[back]


def key_set(keys: DataFrame, column: str) -> tuple[str, int]:
    """Folder and bucket bits of the set of a table's bigint column (no nulls)."""
    bits = max(3, (max(keys.rdd.getNumPartitions(), 1) - 1).bit_length())
    folder = mounted(scratch(keys.sparkSession, "keys"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        every = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)  # of few buckets
        bucket = (every >> np.uint64(64 - bits)).astype(np.int64)
        for b in np.unique(bucket):
            publish(folder, f"f{b}", key=every[bucket == b])
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(every)], pa.int64())})

    bucket = F.shiftrightunsigned(column, 64 - bits)
    with freed_shuffles(keys.sparkSession):
        keys.select(column).repartition(1 << bits, bucket).mapInArrow(write, schema_of(n="bigint")).count()
    return folder, bits


def thinned(rows: DataFrame, column: str, folder: str, bits: int) -> DataFrame:
    """The rows whose bigint ``column`` (null: gone) is in a published set."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeySet(folder, bits)
        for batch in batches:
            keys = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mask = known.known(keys) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            if mask.any():
                yield batch.filter(pa.array(mask))

    return rows.mapInArrow(run, rows.schema)
