"""Embedding near-dedup: tiles of neighbours, pruned by boxes, compared by bounds, verified exactly.

Unit vectors are turned to the main directions of a sample, any turn being exact.  The first
of them and the length of the rest make a short vector; the inner product of two short vectors
is never below the cosine, so a pair whose product stays under it is no link.  All others are
verified by their cosine in double precision.

Disk: a row is known by a 128-bit digest of its vector, so identities travel without vectors.
Vectors are shuffled once, by the leaf of a tree over their short vectors, and written once as
tiles; pairs of tiles are read from there and no vector is copied for them.  Only if most rows
are repeats, a first shuffle drops them.

Skew: equal vectors are one class with a count.  Tiles whose boxes are apart are not compared;
tasks return link counts and spanning edges, never all pairs.  Random vectors of many
dimensions are hard for any exact method: no box parts them, and the number of comparisons
grows with the square of the rows, see the README.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import blake2b
from math import ceil, isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..operators.cluster import _unite, connected_components
from ..runtime import drop_folder, lookup_join, stage
from .exchange import PACKED, bucket_count, packed, release

MAIN_DIMS = 31                # directions of a short vector, besides the length of the rest
TILE = 8192                   # vectors of a tile at most
TILE_BYTES = 4 << 20          # and their bytes
STEP = 256                    # vectors of both sides compared at once, so that their products stay in a core's cache
FLUSH_BYTES = 16 << 20        # a task packs or merges its vectors after this many bytes
SAMPLE, SAMPLE_BYTES = 65_536, 16 << 20      # vectors that directions and tree are fitted on
REPEATS = 2                   # with more rows to a vector, a shuffle of their own drops the repeats
SLACK = 1e-5                  # on products and squared distances, for rounding
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def valid_vector(c) -> "F.Column":
    """Not null, and with a finite component other than zero and no null or other component."""
    return F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def record(dims: int, kind: str) -> np.dtype:
    return np.dtype([("node", "<i8"), ("n", "<i8"), ("vec", kind, (dims,))])


def digests(vectors: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest as two integers, length, all components) of vectors; zeros of both signs are equal."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0
    sizes = np.diff(vectors.offsets.to_numpy())
    ends = np.cumsum(sizes) * flat.itemsize
    view, key = memoryview(flat.tobytes()), salt.to_bytes(8, "little")
    got = b"".join(blake2b(view[e - s:e], digest_size=16, salt=key).digest() for e, s in zip(ends.tolist(), (sizes * flat.itemsize).tolist()))
    return np.frombuffer(got, "<i8").reshape(-1, 2), sizes, flat


def distinct(rec: np.ndarray) -> np.ndarray:
    """One record of each node, in their order, with the sum of the counts."""
    _, at, back = np.unique(rec["node"], return_index=True, return_inverse=True)
    out = rec[at]
    out["n"] = 0
    np.add.at(out["n"], back, rec["n"])
    return out


class Space:
    """Short vectors, and the leaves of a tree of medians over them, fitted on a sample."""

    def __init__(self, sample: np.ndarray, leaves: float):
        self.turn = np.linalg.svd(sample, full_matrices=False)[2][:MAIN_DIMS].T if len(sample) else np.zeros((sample.shape[1], 0))
        x = self.short(sample)
        self.depth = max(0, min(ceil(log2(max(leaves, 1))), int(log2(max(len(x), 8) / 8))))
        self.dim, self.cut = np.zeros(2 ** self.depth - 1, np.int64), np.zeros(2 ** self.depth - 1, np.float32)
        parts = [np.arange(len(x))]
        for node in range(len(self.dim)):
            part = parts[node]
            if len(part):
                self.dim[node] = x[part].var(0).argmax()
                self.cut[node] = np.median(x[part, self.dim[node]])
            above = x[part, self.dim[node]] > self.cut[node]
            parts += [part[~above], part[above]]

    def short(self, units: np.ndarray) -> np.ndarray:
        main = units @ self.turn
        rest = np.sqrt(np.maximum(0, 1 - (main * main).sum(1, keepdims=True)))
        return np.concatenate([main, rest], 1).astype(np.float32)

    def leaf(self, units: np.ndarray) -> np.ndarray:
        # summed in a fixed order, so that equal vectors meet in one leaf whatever stands beside them
        main = np.zeros((len(units), self.turn.shape[1]))
        for k, direction in enumerate(self.turn):
            main += units[:, k:k + 1] * direction
        rest = np.sqrt(np.maximum(0, 1 - (main * main).sum(1, keepdims=True)))
        x = np.concatenate([main, rest], 1).astype(np.float32)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.cut[node])
        return node - (2 ** self.depth - 1)


class Tile:
    """Nodes, counts, unit vectors and short vectors of packed records."""

    def __init__(self, payload, kind: np.dtype, space: Space):
        rec = np.frombuffer(payload, kind)
        self.node, self.n, self.unit = rec["node"], rec["n"], unit(rec["vec"].astype(float))
        self.short = space.short(self.unit)


def windows(a: int, b: int | None) -> Iterator[tuple[slice, slice]]:
    """Rows of a tile and of another one; without ``b`` every pair of rows of one tile once."""
    if b is not None:
        yield from ((slice(s, s + STEP), slice(t, t + STEP)) for s in range(0, a, STEP) for t in range(0, b, STEP))
        return
    pieces = -(-a // STEP)
    for k in range(pieces * (pieces + 1) // 2):
        x, y = tile_pair(k, pieces)
        yield slice(x * STEP, (x + 1) * STEP), slice(y * STEP, (y + 1) * STEP)


def linked(a: np.ndarray, b: np.ndarray, near: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The (row of a, row of b) of the places in ``near`` whose cosine reaches ``cosine``."""
    near = np.flatnonzero(near)
    sure = np.zeros(0, np.int64)
    if len(near) > len(a) * len(b) // 50:        # all products at once; the close ones again, summed as the others are
        cos = (a @ b.T).ravel()[near]
        close = np.abs(cos - cosine) <= 1e-9
        sure, near = near[(cos >= cosine) & ~close], near[close]
    out = [sure]
    for k in range(0, len(near), 50_000):
        at = near[k:k + 50_000]
        out.append(at[np.einsum("ij,ij->i", a[at // len(b)], b[at % len(b)]) >= cosine])
    return np.divmod(np.concatenate(out), len(b))


def compare(a: Tile, b: Tile | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of both tiles (or of one), the links of each, and the smallest place in its component."""
    both = [a] if b is None else [a, b]
    node, n = np.concatenate([t.node for t in both]), np.concatenate([t.n for t in both])
    links, label, first = np.zeros(len(node), np.int64), np.arange(len(node)), 0 if b is None else len(a.node)
    b, within, least = b or a, b is None, np.float32(cosine - SLACK)
    for s, t in windows(len(a.node), None if within else len(b.node)):
        most = a.short[s] @ b.short[t].T
        if most.max() < least:
            continue
        i, j = linked(a.unit[s], b.unit[t], most >= least, cosine)
        i, j = i + s.start, j + t.start + first
        if within:
            i, j = i[i < j], j[i < j]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        _unite(label, i, j)
    return node, links, label


def vector_groups(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two rows link when the cosine of their vectors, in double precision, is at
    least ``cosine``; only vectors of equal length are compared.  Null and zero vectors and
    those with null or non-finite components link with nothing.  A component is named by
    its smallest id, and ``kept`` marks that row.  Rows with equal ids stay rows of their own but
    are one node of a component; a null id links with nothing and has a null component.
    """
    single = isinstance(t := vectors.select(vec_col).schema[0].dataType, ArrayType) and isinstance(t.elementType, FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    usable = valid_vector(F.col("vec")) & F.col("vec_id").isNotNull()
    rows = given.filter(usable)
    keys, again, salt = _keys(rows)
    repeats = {r["dims"]: r["n"] for r in again.groupBy("dims").agg(F.sum(F.col("n") - 1).alias("n")).collect()}
    lengths = [(r["dims"], r["n"]) for r in keys.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()]
    if len(lengths) > 1000:
        raise ValueError("more than 1000 different vector lengths")
    if not lengths:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    results = [_joined(rows.filter(F.size("vec") == d).select("vec"), record(d, kind), salt, n, n - repeats.get(d, 0), cosine, max(1, min(tile, TILE_BYTES // (16 + d * width)))) for d, n in lengths]
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    # an id with different vectors ties their classes
    several = stage(keys.groupBy("vec_id").agg(F.min("node").alias("dst"), F.max("node").alias("last")).filter("dst < last").select("vec_id", "dst"))
    ties = lookup_join(keys, several, ["vec_id"]).select(F.col("node").alias("src"), "dst")
    edges = found.filter(F.col("b").isNotNull()).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ties)
    comps = stage(connected_components(edges))
    degree = found.filter(F.col("b").isNull()).select(F.col("a").alias("node"), "n")
    # what is not alone: repeats, links, components
    none = F.lit(None).cast("long")
    known = stage(degree.select("node", F.col("n").alias("links"), none.alias("component"))
                  .unionByName(again.select("node", (F.col("n") - 1).alias("links"), none.alias("component")))
                  .unionByName(comps.select("node", F.lit(0).cast("long").alias("links"), "component"))
                  .groupBy("node").agg(F.sum("links").alias("links"), F.coalesce(F.max("component"), F.col("node")).alias("component")))
    placed = stage(lookup_join(keys.select("vec_id", "node"), known, ["node"], "left").select("vec_id", "links", "component"))
    grouped = placed.filter(F.col("component").isNotNull())
    first = stage(grouped.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    full = lookup_join(grouped, first, ["component"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = placed.filter(F.col("component").isNull()).select("vec_id").unionByName(given.filter(~usable).select("vec_id"))
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def tile_pair(task: int, tiles: int) -> tuple[int, int]:
    """The (x, y), x <= y, that stands at place ``task`` of all such pairs in order."""
    x = (2 * tiles + 1 - isqrt(max(0, (2 * tiles + 1) ** 2 - 8 * task))) // 2
    while x and x * tiles - x * (x - 1) // 2 > task:         # rounding of the root
        x -= 1
    while (x + 1) * tiles - (x + 1) * x // 2 <= task:
        x += 1
    return x, task - (x * tiles - x * (x - 1) // 2) + x


def _keys(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``vec_id, node, dims`` of all rows, ``node, dims, n`` of nodes with several, and the salt of the digests.

    A node is half a digest; should two digests share it, all are made anew with another salt.
    """
    for salt in range(100):
        def made(batches, salt=salt):
            for batch in batches:
                got, sizes, _ = digests(batch.column(1), salt)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(sizes, pa.int32())], names=["vec_id", "node", "other", "dims"])

        keys = stage(rows.mapInArrow(made, "vec_id long, node long, other long, dims int"))
        again = stage(keys.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("dims").alias("dims"), F.min("other").alias("low"), F.max("other").alias("high")).filter("n > 1"))
        if not again.filter("low < high").limit(1).count():
            break
    else:
        raise RuntimeError("digests of different vectors stay equal")
    return keys.select("vec_id", "node", "dims"), again.select("node", "dims", "n"), salt


def _send(source: DataFrame, records: Callable, place: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Records packed by their place, equal ones of a flush as one."""
    def run(batches):
        held, size = [], 0
        for rec in records(batches):
            held.append(rec)
            size += rec.nbytes
            if size >= FLUSH_BYTES:
                rec = distinct(np.concatenate(held))
                held, size = [], 0
                yield packed(place(rec), rec)
        if held:
            rec = distinct(np.concatenate(held))
            yield packed(place(rec), rec)
        held.clear()
        release()

    return source.mapInArrow(run, PACKED)


def _merged(sent: DataFrame, kind: np.dtype, make: Callable[[np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` of the distinct records of each bucket; repeats leave while a bucket is read."""
    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != last:
                    yield make(distinct(np.concatenate(held)))
                    held, size = [], 0
                last = bucket
                held.append(np.frombuffer(payload.as_buffer(), kind))
                size += held[-1].nbytes
                if size >= FLUSH_BYTES:
                    held, size = [distinct(np.concatenate(held))], 0
        if held:
            yield make(distinct(np.concatenate(held)))
        held.clear()
        release()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


@contextmanager
def _batches(spark, rows: int):
    """Arrow batches of at most ``rows`` rows, since these hold many vectors each."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _joined(rows: DataFrame, kind: np.dtype, salt: int, n_rows: int, n_nodes: int, cosine: float, tile: int) -> DataFrame:
    """Rows (a, null, links of a) and spanning edges (a, b, 0) of vectors of one length, staged."""
    spark, dims = rows.sparkSession, kind["vec"].shape[0]

    def given(batches):
        for batch in batches:
            got, _, flat = digests(batch.column(0), salt)
            rec = np.zeros(len(batch), kind)
            rec["node"], rec["n"], rec["vec"] = got[:, 0], 1, flat.reshape(-1, dims)
            yield rec

    def kept(batches):
        for batch in batches:
            yield from (np.frombuffer(p.as_buffer(), kind) for p in batch.column(0))

    source, records, rows_at_once = rows, given, int(spark.conf.get(_BATCH))
    if n_rows > REPEATS * n_nodes:
        buckets = bucket_count(spark, n_rows * kind.itemsize)
        payload = lambda rec: pa.RecordBatch.from_arrays([pa.array([rec.tobytes()], pa.binary())], names=["payload"])
        with _batches(spark, buckets):
            source = stage(_merged(_send(rows, given, lambda rec: rec["node"].view(np.uint64) % np.uint64(buckets)), kind, payload, "payload binary"))
        records, rows_at_once = kept, 4

    wanted = min(SAMPLE, SAMPLE_BYTES // (4 * dims) + 1) / n_nodes

    def sampled(batches):
        for rec in records(batches):
            rec = distinct(rec[rec["node"].view(np.uint64) / 2.0 ** 64 < wanted])
            yield pa.RecordBatch.from_arrays([pa.array([rec.tobytes()], pa.binary())], names=["payload"])

    with _batches(spark, rows_at_once):
        sample = distinct(np.frombuffer(b"".join(bytes(r[0]) for r in source.mapInArrow(sampled, "payload binary").collect()), kind))
    space = Space(unit(sample["vec"].astype(float)) if len(sample) else np.zeros((0, dims)), n_nodes / tile)

    def tiles_of(rec: np.ndarray) -> pa.RecordBatch:
        x = space.short(unit(rec["vec"].astype(float)))
        cuts = np.linspace(0, len(rec), -(-len(rec) // tile) + 1).astype(int)
        spans = list(zip(cuts[:-1], cuts[1:]))
        floats = pa.list_(pa.float32())
        return pa.RecordBatch.from_arrays([pa.array([int(rec["node"][s]) for s, _ in spans]), pa.array([x[s:e].min(0) for s, e in spans], floats), pa.array([x[s:e].max(0) for s, e in spans], floats),
                                           pa.array([rec[s:e].tobytes() for s, e in spans], pa.binary())], names=["tile", "low", "high", "payload"])

    with _batches(spark, 4 if records is kept else max(64, 2 ** space.depth)):
        place = lambda rec: space.leaf(unit(rec["vec"].astype(float)))
        tiles = stage(_merged(_send(source, records, place), kind, tiles_of, "tile long, low array<float>, high array<float>, payload binary"))
    if source is not rows:
        _dropped(source)

    a, b = (tiles.select(*(F.col(c).alias(f"{side}_{c}") for c in tiles.columns)) for side in "ab")
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    apart = F.zip_with(minus("a_low", "b_high"), minus("b_low", "a_high"), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    gap = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)
    # a task reads its part of the first side as a stream and keeps that of the second, so few parts of the first will do
    pairs = a.coalesce(2 * spark.sparkContext.defaultParallelism).hint("shuffle_replicate_nl").join(b, (F.col("a_tile") <= F.col("b_tile")) & (gap <= 2 - 2 * cosine + SLACK)).select("a_tile", "b_tile", "a_payload", "b_payload")

    def work(batches):
        held: dict[int, pa.Buffer] = {}
        side = lru_cache(12)(lambda t: Tile(held[t], kind, space))
        for batch in batches:
            for x, y, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                held.clear()
                held.update({x: p.as_buffer(), y: q.as_buffer()})
                node, links, label = compare(side(x), None if x == y else side(y), cosine)
                hit, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([node[hit], node[moved]])), pa.array(np.concatenate([np.zeros(len(hit), np.int64), node[label[moved]]]), mask=np.arange(len(hit) + len(moved)) < len(hit)),
                         pa.array(np.concatenate([links[hit], np.zeros(len(moved), np.int64)]))], names=["a", "b", "n"])
        side.cache_clear()
        release()

    with _batches(spark, 4):                 # a row holds two tiles
        found = stage(pairs.mapInArrow(work, "a long, b long, n long"))
    _dropped(tiles)
    return found


def _dropped(staged: DataFrame) -> None:
    """Removes the files of ``stage`` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        drop_folder(staged.sparkSession, folder)
