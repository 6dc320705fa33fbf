"""Exact neighbour work on vectors, in bounded tiles.

Points are assigned to the nearest of a few hundred pivots.  A point u can have
a neighbour within ε in the cell of pivot j only if

    (d(u, p_j)² − d(u, p_i)²) / (2·|p_i − p_j|) ≤ ε   and   d(u, p_j) ≤ radius_j + ε

(distance to the bisecting plane, and the cell radius), so it meets only those
cells.  Cells that lie close together form a group of at most ``block_rows``
home points, larger cells are cut into blocks by hash.  A task holds one block
and the points that reach its cells pass it by: each travels once per block,
not once per tile, and ``tile_rows`` points of a cell are compared at once.
Distances are worked out in single precision with a margin; what lies within
it is settled in double precision.  Tasks emit sums, spanning edges or true
neighbours, never all pairs.  Vectors that no bound can separate are all
compared: that is the square of their number, but each of them travels only
rows / ``block_rows`` times.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import number_ordered, stage

TILE_ROWS = 4096
BLOCK_ROWS, STREAM_ROWS = 32_768, 4096      # home points of a task; points that pass it by at once
PASSING_ROWS = 131_072                      # points that pass by one task, unless that leaves cores idle
ROWS_PER_PIVOT, MAX_PIVOTS = 4096, 256
TILE_PAIRS, HIT_ROWS = 1 << 20, 100_000     # distances at once; pairs of one output batch
SLACK = 1e-6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _pair_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the same rows of ``b``."""
    d = np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b) - 2.0 * np.einsum("ij,ij->i", a, b)
    return np.maximum(d, 0.0)


class Side:
    """Vectors of one side of a comparison, in both precisions."""

    def __init__(self, vec: np.ndarray):
        self.vec = vec
        self.norm = np.einsum("ij,ij->i", vec, vec)
        self.largest = self.norm.max(initial=0.0)
        self.narrow = bool(self.largest < 1e15)              # false for non-finite values, too
        if self.narrow:
            self.vec4, self.norm4 = vec.astype(np.float32), self.norm.astype(np.float32)


def within(a: Side, rows: np.ndarray, b: Side, cols: np.ndarray, limit: np.ndarray, tile_rows: int,
           exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pairs of ``rows`` and ``cols`` with a squared distance of at most ``limit`` (one number per row of ``b``, read anew for each tile).

    Yields rows, columns and, if ``exact``, squared distances of some pairs at a time.
    """
    narrow = a.narrow and b.narrow
    margin = 1e-6 * (4 + a.vec.shape[1] / 16) * (a.largest + b.largest) if narrow else 0.0
    if narrow:
        turned, own = np.ascontiguousarray(b.vec4[cols].T), b.norm4[cols][None, :]
    step = max(1, min(tile_rows, TILE_PAIRS // len(cols)))
    for at in range(0, len(rows), step):
        r = rows[at:at + step]
        if narrow:
            near = a.vec4[r] @ turned
            near *= np.float32(-2.0)
            near += own
            near += a.norm4[r][:, None]
        else:
            near = _squared(a.vec[r], b.vec[cols])
        hit = np.flatnonzero(near <= (limit[cols] + margin).astype(near.dtype)[None, :])
        for k in range(0, len(hit), HIT_ROWS):
            i, j = np.divmod(hit[k:k + HIT_ROWS], len(cols))
            open_ = np.ones(len(i), bool) if exact else near[i, j] >= limit[cols[j]] - margin
            i, j = r[i], cols[j]
            d = _pair_squared(a.vec[i[open_]], b.vec[j[open_]])
            keep = np.ones(len(i), bool)
            keep[open_] = d <= limit[j[open_]]
            if keep.any():
                yield i[keep], j[keep], d[keep] if exact else None


def choose_pivots(points: DataFrame, n: int) -> np.ndarray:
    """At most MAX_PIVOTS vectors, picked by hash; the only vectors that reach the driver."""
    count = int(min(MAX_PIVOTS, max(1, -(-n // ROWS_PER_PIVOT))))
    rows = points.orderBy(F.xxhash64("id", F.lit(11))).limit(count).select("vec").collect()
    return np.unique(np.array([r[0] for r in rows], dtype=np.float64), axis=0)


def _reached(d2: np.ndarray, home: np.ndarray, between: np.ndarray, radius: np.ndarray, eps) -> np.ndarray:
    """Which cells (columns) can hold a point within ``eps``, one number or one per row, of each row."""
    eps = np.broadcast_to(np.asarray(eps, dtype=np.float64), len(d2))[:, None]
    own = np.arange(len(d2)), home
    gap = between[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d2 - d2[own][:, None]) / (2.0 * gap), 0.0)
    near = (plane <= eps + SLACK) & (np.sqrt(d2) <= radius[None, :] + eps + SLACK)
    near[own] = True
    return near


def _chain(between: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest one that is left."""
    left, order = np.ones(len(between), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, between[order[-1]], np.inf).argmin()) if np.isfinite(between[order[-1]][left]).any() else int(left.argmax()))
        left[order[-1]] = False
    return order


class Cells:
    """Points (``id, w, vec``) with home cells, their groups, and the points that reach a group for one ε."""

    def __init__(self, points: DataFrame, eps: float, tile_rows: int = TILE_ROWS, block_rows: int | None = None):
        self.eps, self.tile_rows = float(eps), tile_rows
        self.n = n = points.count()
        self.kind = kind = points.schema["id"].dataType.simpleString()
        self.cores = points.sparkSession.sparkContext.defaultParallelism
        # fewer rows than ``BLOCK_ROWS`` where that would leave cores idle
        self.block_rows = block_rows or min(BLOCK_ROWS, max(128, -(-n // (2 * self.cores))))
        if n <= ROWS_PER_PIVOT:              # one cell
            self.pivots, self.reach = None, lambda vec, home, eps: np.ones((len(vec), 1), bool)
            self.homes = points.select("id", "w", "vec", F.lit(0).alias("home"))
            self.group, sizes = np.zeros(1, np.int64), [n]
        else:
            pivots = self.pivots = choose_pivots(points, n)

            def home(batches):
                for pdf in batches:
                    if len(pdf):
                        d = _squared(_matrix(pdf["vec"]), pivots)
                        pdf["home"] = d.argmin(1)
                        pdf["reach"] = np.sqrt(d.min(1))
                        yield pdf

            self.homes = stage(points.select("id", "w", "vec").mapInPandas(
                home, f"id {kind}, w double, vec array<float>, home int, reach double"))
            cells = {r["home"]: (r["n"], r["r"]) for r in self.homes.groupBy("home").agg(
                F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect()}       # one row per pivot
            radius = np.array([cells.get(j, (0, -np.inf))[1] for j in range(len(pivots))])
            between = np.sqrt(_squared(pivots, pivots))
            # which cells (columns) each point reaches
            self.reach = lambda vec, home, eps: _reached(_squared(vec, pivots), home, between, radius, eps)
            self.group, sizes = np.zeros(len(pivots), np.int64), [0]
            for j in _chain(between):
                rows = cells.get(j, (0, 0.0))[0]
                if sizes[-1] and sizes[-1] + rows > self.block_rows:
                    sizes.append(0)
                self.group[j] = len(sizes) - 1
                sizes[-1] += rows
        self.blocks = np.array([max(1, -(-int(s) // self.block_rows)) for s in sizes])

    def run(self, left: DataFrame, right: DataFrame, fn: Callable, schema: str, near: Callable | None = None) -> DataFrame:
        """Apply ``fn(block, passing)`` to each block of home points and the points that reach one of its cells.

        Both sides have ``id, vec, home``.  ``near(rows)`` says which cells each row of ``right`` reaches, by default those within ε.
        ``passing`` yields (rows, pairs): some of these points, and ``pairs(limit, exact)`` that goes through the pairs of block and
        rows whose cells meet (see ``within``).  ``fn`` yields tables.  A task holds a block, and of the other side ``STREAM_ROWS`` rows.
        """
        reach, eps = self.reach, self.eps
        near = near or (lambda pdf: reach(_matrix(pdf["vec"]), pdf["home"].to_numpy(), eps))
        group, blocks, tile_rows = self.group, self.blocks, self.tile_rows
        groups = len(blocks)

        def reached(batches):
            for pdf in batches:
                if len(pdf):
                    hit = np.zeros((len(pdf), groups), bool)
                    cells = near(pdf)
                    for g in range(groups):
                        hit[:, g] = cells[:, group == g].any(1)
                    yield pdf.assign(groups=[np.flatnonzero(h).astype(np.int32) for h in hit])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in right.schema.fields)
        guests = stage(right.mapInPandas(reached, fields + ", groups array<int>"))
        met = {r["g"]: r["n"] for r in guests.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per group
        rows_of = np.array([met.get(g, 0) for g in range(groups)])
        # a group's guests are dealt to several tasks, so that cores share the work however few the blocks are
        share = max(1, min(PASSING_ROWS, int((rows_of * blocks).sum()) // (4 * self.cores)))
        share = max(share, self.block_rows)                  # the block travels to each of them
        parts = np.maximum(1, -(-rows_of // share))
        first = np.concatenate([[0], np.cumsum(blocks * parts)])
        total = int(first[-1])
        constant = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
        of = lambda xs, g: F.element_at(constant(xs), g + 1)
        g = F.element_at(constant(group), F.col("home") + 1)
        block = F.pmod(F.xxhash64("id", F.lit(1)), of(blocks, g))
        a = left.select("*", F.lit(0).alias("_side"), F.explode(F.sequence(F.lit(0), of(parts, g) - 1)).alias("_p"))
        a = a.withColumn("_work", (of(first, g) + block * of(parts, g) + F.col("_p")).cast("int")).drop("_p")
        b = guests.select(*right.columns, F.lit(1).alias("_side"), F.explode("groups").alias("_g"))
        part = F.pmod(F.xxhash64("id", F.lit(2)), of(parts, F.col("_g")))
        b = b.select("*", F.explode(F.sequence(F.lit(0), of(blocks, F.col("_g")) - 1)).alias("_b"))
        b = b.withColumn("_work", (of(first, F.col("_g")) + F.col("_b") * of(parts, F.col("_g")) + part).cast("int")).drop("_g", "_b")
        both = a.unionByName(b, allowMissingColumns=True)
        tasks = min(total, 10_000)

        def runs(batches):
            for pdf in batches:
                key = pdf[["_work", "_side"]].to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(pdf)]):
                    if j > i:
                        yield int(key[i, 0]), int(key[i, 1]), pdf.iloc[i:j]

        def passing(block: pd.DataFrame, rest):
            home, own = block["home"].to_numpy(), Side(_matrix(block["vec"]))
            cells = [(c, np.flatnonzero(home == c)) for c in np.unique(home)]
            held, rows = [], 0
            for piece in itertools.chain(rest, [None]):
                if piece is not None:
                    held.append(piece)
                    rows += len(piece)
                if not held or (piece is not None and rows < STREAM_ROWS):
                    continue
                pdf, held, rows = pd.concat(held, ignore_index=True), [], 0
                other, meet = Side(_matrix(pdf["vec"])), near(pdf)

                def pairs(limit, exact=True, other=other, meet=meet):
                    for c, at in cells:
                        cols = np.flatnonzero(meet[:, c])
                        if len(cols):
                            yield from within(own, at, other, cols, limit, tile_rows, exact)

                yield pdf, pairs

        def work(batches):
            for _, pieces in itertools.groupby(runs(batches), lambda x: x[0]):
                held = []
                for _, side, pdf in pieces:
                    if side:
                        if held:
                            block = pd.concat(held, ignore_index=True)
                            yield from fn(block, passing(block, itertools.chain([pdf], (x[2] for x in pieces))))
                        break
                    held.append(pdf)

        return (both.repartitionById(tasks, F.pmod("_work", F.lit(tasks))).sortWithinPartitions("_work", "_side")
                .mapInPandas(work, schema))


def batched(parts: Iterator[tuple[np.ndarray, ...]], rows: int = HIT_ROWS) -> Iterator[list[np.ndarray]]:
    """Columns of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def eps_neighbors(points: DataFrame, eps: float, tile_rows: int = TILE_ROWS, block_rows: int | None = None) -> DataFrame:
    """All pairs ``id < other`` with Euclidean distance ≤ ε, and the distance."""
    cells = Cells(points, eps, tile_rows, block_rows)
    limit = cells.eps ** 2

    def pairs(block: pd.DataFrame, passing):
        xi = block["id"].to_numpy()
        for rows, near in passing:
            yi = rows["id"].to_numpy()
            found = ((xi[r], yi[c], np.sqrt(d)) for r, c, d in near(np.full(len(rows), limit)))
            for x, y, d in batched((x[x < y], y[x < y], d[x < y]) for x, y, d in found):
                yield pd.DataFrame({"id": x, "other": y, "dist": d})

    rows = cells.homes.select("id", "vec", "home")
    return cells.run(rows, rows, pairs, f"id {cells.kind}, other {cells.kind}, dist double")


def _smallest(best: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
    """Takes the numbers ``d`` into the rows ``at`` of ``best``, which hold the smallest ones in order."""
    k = best.shape[1]
    rows, number = np.unique(at, return_inverse=True)
    key = np.concatenate([np.repeat(np.arange(len(rows)), k), number])
    value = np.concatenate([best[rows].ravel(), d])
    order = np.lexsort((value, key))
    first = np.concatenate([[0], np.cumsum(np.bincount(key))[:-1]])
    best[rows] = value[order][first[:, None] + np.arange(k)[None, :]]


def kth_distance(points: DataFrame, k: int, block: int = 2048, block_rows: int | None = None) -> DataFrame:
    """``id, dist`` to the k-th nearest other point (the farthest, if there are fewer), exact for all points.

    The k-th distance within the own cell, or to the k nearest pivots that are other points,
    bounds the answer from above; only cells within that bound are looked at next.
    """
    points = stage(points.select("id", F.lit(1.0).alias("w"), "vec"))
    n = points.count()
    k = min(k, n - 1)
    if k < 1:
        return points.select("id", F.lit(0.0).alias("dist"))
    cells = Cells(points, 0.0, block, block_rows)
    kind = cells.kind

    def nearest(x: pd.DataFrame, passing):
        """The k smallest distances from each passing row to the rows of the block, as far as they are within its bound."""
        xi, own = x["id"].to_numpy(), x["home"].to_numpy()
        for y, near in passing:
            yi, home = y["id"].to_numpy(), y["home"].to_numpy()
            best, limit = np.full((len(y), k), np.inf), np.full(len(y), np.inf)
            if "bound" in y:
                limit = (y["bound"].fillna(np.inf).to_numpy() + SLACK) ** 2
            for c in np.intersect1d(own, home) if "bound" not in y else []:       # a few distances within the cell give the first limits
                some, cols = np.flatnonzero(own == c)[:4 * k + 64], np.flatnonzero(home == c)
                d = _squared(_matrix(y["vec"].iloc[cols]), _matrix(x["vec"].iloc[some]))
                d[yi[cols][:, None] == xi[some][None, :]] = np.inf
                if len(some) >= k:
                    limit[cols] = np.partition(d, k - 1, axis=1)[:, k - 1] + SLACK
            for r, c, d in near(limit):
                better = (xi[r] != yi[c]) & (d < best[c, -1])
                if better.any():
                    _smallest(best, c[better], d[better])
                    limit[:] = np.where(best[:, -1] > 0, np.minimum(limit, best[:, -1]), -np.inf)       # nothing is nearer than equal points
            yield pd.DataFrame({"id": y["id"], "ds": [np.sqrt(row[np.isfinite(row)]).tolist() for row in best]})

    def smallest(parts: DataFrame) -> DataFrame:
        return parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, k).alias("ds"))

    schema = f"id {kind}, ds array<double>"
    homes = cells.homes.select("id", "vec", "home")
    near = smallest(cells.run(homes, homes, nearest, schema))
    if cells.pivots is not None:
        near = stage(near)

        reach = cells.reach

        def beyond(pdf: pd.DataFrame) -> np.ndarray:
            vec, home = _matrix(pdf["vec"]), pdf["home"].to_numpy()
            return reach(vec, home, pdf["bound"].fillna(np.inf).to_numpy()) & ~reach(vec, home, 0.0)

        pivots = cells.pivots

        def bound(batches):
            for pdf in batches:
                if len(pdf):
                    b = pdf["bound"].fillna(np.inf).to_numpy()
                    if len(pivots) > k:            # k of the k + 1 nearest pivots are other points
                        b = np.minimum(b, np.sqrt(np.partition(_squared(_matrix(pdf["vec"]), pivots), k, axis=1)[:, k]))
                    yield pdf.assign(bound=b)

        bounded = homes.join(near.select("id", F.get("ds", F.lit(k - 1)).alias("bound")), "id").select("id", "vec", "home", "bound")
        asked = bounded.mapInPandas(bound, f"id {kind}, vec array<float>, home int, bound double")
        near = smallest(near.unionByName(cells.run(homes, asked, nearest, schema, beyond)))
    return near.select("id", F.get("ds", F.lit(k - 1)).alias("dist"))


def estimate_eps(points: DataFrame, k: int = 4, lo: float = 0.15, hi: float = 0.90) -> DataFrame:
    """One row ``n, eps``: the elbow of the sorted k-distances of all points, clipped; 0.5 for tiny inputs."""
    dist = stage(kth_distance(points, k))
    m, y0, y1 = dist.agg(F.count(F.lit(1)), F.min("dist"), F.max("dist")).first()
    ranked = number_ordered(dist, [F.col("dist"), F.col("id")], "i")
    slope = (y1 or 0.0) - (y0 or 0.0)
    x = F.col("i") / F.lit(max(m - 1, 1))
    chord = F.abs(F.lit(slope) * x - F.col("dist") + F.lit(y0)) / F.lit((1.0 + slope * slope) ** 0.5)
    best = ranked.withColumn("d", chord).agg(F.max_by("dist", F.struct(F.round("d", 12), -F.col("i"))).alias("eps"))
    picked = F.lit(0.5) if m <= k + 1 else F.least(F.greatest(F.when(F.col("eps") > 0, F.col("eps")).otherwise(0.5), F.lit(lo)), F.lit(hi))
    return best.select(F.lit(m).cast("long").alias("n"), picked.alias("eps"))
