"""Shuffling fixed-width records as packed blobs.

Map tasks pack numpy records by bucket into few binary rows; a reduce task gathers the
blobs of its buckets, one bucket to a task.  Rows that carry a key pass through.  There are at
least ``spark.sql.shuffle.partitions`` buckets, and one for every BUCKET_BYTES of input, so what
a task gathers stays bounded however large the input is and whatever that setting is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import input_bytes, partitions, thrifty

BUCKET_BYTES = 16_000_000  # of compressed input
SCHEMA = "bucket int, key long, data binary"
NAMES = ["bucket", "key", "data"]


class Out:
    """Rows of SCHEMA, given out as Arrow batches of a few MB."""

    def __init__(self, most: int = 8_000_000):
        self.rows: list[tuple[int, int | None, bytes]] = []
        self.size, self.most = 0, most

    def add(self, bucket: int, key: int | None, data: bytes) -> None:
        self.rows.append((bucket, key, data))
        self.size += len(data) + 40

    def take(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.size > self.most):
            buckets, keys, data = zip(*self.rows)
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], NAMES)


def split_by(out: Out, bucket: np.ndarray, records: np.ndarray) -> None:
    """Add one blob for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])):
        if hi > lo:
            out.add(int(bucket[lo]), None, records[lo:hi].tobytes())


def by_key(out: Out, bucket: int, keys: np.ndarray, records: np.ndarray, spread: int = 1) -> None:
    """Add one keyed blob for each distinct key; such rows pass the reduce side unchanged."""
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
        if hi > lo:
            out.add(bucket if spread <= 1 else int(keys[lo]) % spread, int(keys[lo]), records[lo:hi].tobytes())


def n_buckets(df: DataFrame) -> int:
    """Buckets for what is made of ``df``."""
    return max(partitions(df.sparkSession), (input_bytes(df) or 0) // BUCKET_BYTES)


def reduce_buckets(rows: DataFrame, reduce: Callable[[list[bytes], Out, int], None], n: int) -> DataFrame:
    """Keyed rows of SCHEMA: those of ``rows`` that have a key, and what ``reduce`` adds for
    the blobs of each of the ``n`` buckets."""
    def run(batches):
        held: dict[int, list[bytes]] = {}
        out = Out()
        for batch in batches:
            for bucket, key, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if key is None:
                    held.setdefault(bucket, []).append(data)
                else:
                    out.add(bucket, key, data)
            yield from out.take()
        for bucket in sorted(held):
            reduce(held.pop(bucket), out, bucket)
            yield from out.take()
        yield from out.take(last=True)

    return rows.repartitionById(n, F.col("bucket")).mapInArrow(thrifty(run), SCHEMA)
