"""Packed exchange: many small fixed-width records travel as a few binary rows.

A task packs its records by bucket, Spark shuffles the (bucket, payload) rows,
and the group of a bucket is unpacked into numpy arrays.  The number of buckets
follows the number of records, so that a bucket stays near ``BUCKET_BYTES``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 4 << 20         # a task packs its records after this many bytes
PACKED = "bucket int, payload binary"
TEXTS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay near a few MB: the default number of rows is lowered, a user's own stays."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, TEXTS_PER_BATCH)


def release() -> None:
    """Gives freed memory of a worker back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bucket_count(spark: SparkSession, total_bytes: float) -> int:
    """Buckets for about ``total_bytes`` of records, at least one per shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // BUCKET_BYTES) + 1)


def packed(buckets: np.ndarray, records: np.ndarray, kind: type = np.int32) -> pa.RecordBatch:
    """One binary row per bucket, whose number is a ``kind``."""
    order = np.argsort(buckets, kind="stable")
    b, r = buckets[order], records[order]
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    ends = np.append(starts[1:], len(b))
    return pa.RecordBatch.from_arrays(
        [pa.array(b[starts].astype(kind)), pa.array([r[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
        names=["bucket", "payload"])


def gather(batches: Iterator[pa.RecordBatch], make: Callable, flush: Callable, limit: int = FLUSH_BYTES) -> Iterator:
    """Collect ``make(slice)`` record arrays over a task's batches and flush them in groups of ``limit`` bytes."""
    from .words import chunks

    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for start, end in chunks(texts):
            got = make(batch.slice(start, end - start))
            if got is not None and len(got):
                held.append(got)
                size += got.nbytes
            if size >= limit:
                yield from flush(np.concatenate(held))
                held, size = [], 0
    if held:
        yield from flush(np.concatenate(held))
    held.clear()
    release()


def by_bucket(df: DataFrame, kind: np.dtype, work: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on all records of one bucket at a time."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = work(np.frombuffer(b"".join(bytes(p) for p in part["payload"]), kind))
        release()
        return out

    return df.groupBy("bucket").applyInPandas(run, schema)
