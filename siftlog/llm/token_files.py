"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are range-partitioned by id and sorted; each partition encodes its
texts into one shard of three files next to each other:

    <shard>.bin   all ids, little-endian, 2 bytes each where the vocabulary fits, else 4
    <shard>.off   n + 1 little-endian 64-bit offsets, in ids
    <shard>.doc   n little-endian 64-bit document ids

The manifest has one row per shard; running sums over it give each shard's place
in the whole.  A task attempt writes under a name of its own and only the
attempt that succeeds is named in the manifest, so a lost executor leaves no
wrong file behind.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import stage, staging_root
from .bpe import encoder
from .exchange import text_batches
from .words import chunks

SHARD_BYTES = 64 << 20        # of text
MANIFEST = "shard long, path string, n_docs long, n_ids long, width int"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) below ``folder`` and return the manifest with ``base``, the ids of all shards before.

    Every document ends with ``end_id``; a null or empty text has that id only.
    Rows with one id stay rows, in the order of their texts; null ids come first and are
    stored as the smallest 64-bit integer.  ``folder`` must be shared by all executors.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // SHARD_BYTES) + 1)
    ordered = given.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        shard = TaskContext.get().partitionId()
        enc = encoder(path)
        width = 2 if len(enc.names) <= 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        end = np.array([end_id], kind).tobytes()
        store, base = _open(f"{folder}/{shard:06d}-{uuid.uuid4().hex}")
        sizes, ids, sink = [], [], None
        for batch in batches:
            sink = sink or _new(store, base)
            for a, b in chunks(batch.column(1)):
                own = batch.column(0).slice(a, b - a).fill_null(np.iinfo(np.int64).min)
                ids.append(own.to_numpy().astype("<i8"))
                for raw in enc.ids_bytes([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]):
                    raw = np.frombuffer(raw, "<u4").astype(kind).tobytes() + end
                    sizes.append(len(raw) // width)
                    sink.write(raw)
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.uint64))]).astype("<u8")
        for name, data in ((".off", offsets), (".doc", np.concatenate(ids) if ids else np.zeros(0, "<i8"))):
            with store.open_output_stream(base + name) as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{folder}/{base.rsplit('/', 1)[-1]}"]), pa.array([len(sizes)], pa.int64()),
                                          pa.array([int(offsets[-1])], pa.int64()), pa.array([width], pa.int32())],
                                         names=["shard", "path", "n_docs", "n_ids", "width"])

    manifest = stage(ordered.mapInArrow(write, MANIFEST))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)            # one row per shard
    return stage(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")))


def _new(store, base: str):
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(base + ".bin")


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is a file of the machine, else read."""
    from pyarrow import fs

    store, at = _open(uri)
    if store.get_file_info(at).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(at, dtype=kind, mode="r")
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``ids`` too if asked for.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as 32-bit little-endian integers.
    """
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(row["path"] + ".bin", f"<u{row['width']}")
                off, doc = mapped(row["path"] + ".off", "<u8").astype(np.int64), mapped(row["path"] + ".doc", "<i8")
                for a in range(0, len(doc), 2000):
                    b = min(a + 2000, len(doc))
                    own = [ids[off[i]:off[i + 1]].astype("<u4") for i in range(a, b)]
                    null = np.array(doc[a:b]) == np.iinfo(np.int64).min
                    columns = [pa.array(np.array(doc[a:b]), mask=null), pa.array(off[a:b] + row["base"]), pa.array(np.diff(off[a:b + 1])),
                               pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(read, kinds)


def token_folder(spark) -> str:
    """A new folder in the shared place of intermediate files."""
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
