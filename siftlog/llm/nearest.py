"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

A further coordinate makes all vectors equally long, so that the largest inner product is
the smallest distance.  The tree is fitted level by level on about ``SAMPLE`` vectors at most
(each node is clustered by itself), but every row is put into a leaf.

A query keeps its nodes in a priority queue by the distance to their centre, opens the nearest and
visits leaves in the order in which they come out.  How many leaves is calibrated: for
``CALIBRATION`` of the queries the exact neighbours are found by one scan, and the visits are
widened until ``recall`` of these neighbours lie in visited leaves.  The neighbours of
a query come from all its leaves, scored in double precision on the given vectors.

Skew: small leaves are worked on together, a large one in tiles of rows and of queries, so one with a third
of all rows (copies of one vector) is many tasks.  Only the best ``k`` of a query and tile leave a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import lookup_join, stage
from .vectors import valid_vector

SAMPLE = 65_536               # vectors that the tree is fitted on, at most
BRANCHES = 16                 # children of a node
NODE_SAMPLE = 4096            # of them for the clustering of one node
LEAF_SAMPLE = 32              # sampled vectors of a leaf, so there are at most SAMPLE / LEAF_SAMPLE leaves and some
LEAF_ROWS = 256               # rows of a leaf that the tree aims at while the sample allows it
CALIBRATION = 256             # queries whose exact neighbours are found
RECALL = 0.97                 # share of the exact neighbours that lie in visited leaves
TILE_ROWS, TILE_QUERIES = 16_384, 4096


def scores(queries: np.ndarray, vecs: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q, r), summed coordinate by coordinate, so that equal vectors score equally wherever they stand."""
    out = np.zeros(len(q))
    for d in range(vecs.shape[1]):
        out += queries[q, d] * vecs[r, d]
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, vecs: np.ndarray, ids: np.ndarray, k: int,
            only: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the ``k`` best rows of each query without rows of its own id; of equal scores the smaller ids.

    ``only`` holds which leaves (by number) a query sees, and the leaf of each row.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    size = np.abs(vecs).max(initial=0.0)
    for a in range(0, len(queries), 256):
        part = queries[a:a + 256]
        near = part @ vecs.T
        near[query_ids[a:a + 256, None] == ids] = -np.inf
        if only is not None:
            near[~only[0][a:a + 256][:, only[1]]] = -np.inf
        able = near > -np.inf
        if len(ids) > k:
            least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
            slack = 1e-9 * np.abs(part).sum(1) * size                      # rounding of the product, so that no tie is lost
            able &= near >= np.where(np.isfinite(least) & np.isfinite(slack), least - slack, -np.inf)[:, None]
        q, r = np.nonzero(able)
        s = scores(part, vecs, q, r)
        order = np.lexsort((ids[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, np.arange(len(part)))
        keep = np.arange(len(q)) - first[q] < k
        out.append((a + q[keep], r[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; started from rows spread over the data, the same for the same rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(len(x))
    centres = [x[rng.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and gap.max() > 0:
        centres.append(x[np.searchsorted(np.cumsum(gap), rng.random() * gap.sum())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = (-2 * (x @ c.T) + (c * c).sum(1)).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if np.array_equal(new, c):
            break
        c = new
    return c


class Tree:
    """Centres of all nodes and ``children`` of each (none: a leaf); vectors count in units of ``unit``, the longest is ``longest`` of them."""

    def __init__(self, centres: np.ndarray, children: list[list[int]], unit: float, longest: float):
        self.centres, self.children, self.unit, self.longest = centres, children, unit, longest
        self.leaf = np.array([not c for c in children])
        self.size = (centres * centres).sum(1)

    def lifted(self, vecs: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes them as long as the longest."""
        vecs = vecs / self.unit
        rest = self.longest ** 2 - (vecs * vecs).sum(1)
        return np.concatenate([vecs, np.sqrt(np.maximum(rest, 0))[:, None]], axis=1)

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Queries as long as the longest vector, which changes no order."""
        queries = queries / np.abs(queries).max(1, keepdims=True)
        queries = queries * (self.longest / np.sqrt((queries * queries).sum(1, keepdims=True)))
        return np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance to every node, but for the point's own length."""
        return self.size - 2 * (points @ self.centres.T)

    def place(self, vecs: np.ndarray) -> np.ndarray:
        """The leaf of each vector: always the nearest child."""
        out = np.zeros(len(vecs), np.int64)
        for a in range(0, len(vecs), 1024):
            gap, node = self.distances(self.lifted(vecs[a:a + 1024])), np.zeros(len(vecs[a:a + 1024]), np.int64)
            while not self.leaf[node].all():
                for n in np.unique(node[~self.leaf[node]]):
                    at, kids = np.flatnonzero(node == n), np.array(self.children[n])
                    node[at] = kids[gap[np.ix_(at, kids)].argmin(1)]
            out[a:a + 1024] = node
        return out

    def visits(self, queries: np.ndarray, most: int | None = None) -> Iterator[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        for a in range(0, len(queries), 1024):
            for gap in self.distances(self.asked(queries[a:a + 1024])):
                queue, seen = [(0.0, 0)], []
                while queue and (most is None or len(seen) < most):
                    _, node = heapq.heappop(queue)
                    if self.leaf[node]:
                        seen.append(node)
                    for kid in self.children[node]:
                        heapq.heappush(queue, (gap[kid], kid))
                yield seen


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _lot(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n))


def top_k(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key with their ``rank``; rows beyond leave before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def fit_tree(vectors: DataFrame, dims: int, rows: int, sample: int = SAMPLE, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree of ``vectors(vec_id, vec)``, fitted on about ``sample`` rows, picked by hash.

    Level by level each node is clustered by itself, on at most about ``NODE_SAMPLE`` of its rows.
    """
    unit = float(vectors.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0])
    long = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit))
    tree = Tree(np.zeros((1, dims + 1)), [[]], unit, float(vectors.agg(F.max(long)).first()[0]) ** 0.5)
    now = stage(vectors.filter(_lot(1_000_003) < 1_000_003 * min(1.0, sample / rows)).withColumn("node", F.lit(0).cast("long")))
    target = max(LEAF_SAMPLE, int(min(rows, sample) * leaf_rows // rows))       # sampled vectors of a leaf
    kind = vectors.schema["vec"].dataType.simpleString()

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got = k_means(tree.lifted(np.stack(part["vec"].to_numpy()).astype(float)), min(branches, -(-int(part["count"].iloc[0]) // target)))
        got = got if len(got) > 1 else got[:0]                              # copies of one vector stay a leaf
        return pd.DataFrame({"node": np.full(len(got), key[0]), "centre": pd.Series(list(got), dtype=object)})

    centres, children = [np.zeros(dims + 1)], [[]]
    while True:
        large = stage(now.groupBy("node").count().filter(F.col("count") > target))
        some = lookup_join(now, large, ["node"]).filter(F.pmod(F.xxhash64("vec", "vec_id"), F.lit(1_000_003)) < 1_000_003.0 * NODE_SAMPLE / F.col("count"))
        found = some.groupBy("node").applyInPandas(split, "node long, centre array<double>").collect()      # a few per leaf, and leaves are bounded by the sample
        if not found:
            return tree
        fresh = []
        for node, centre in sorted((r["node"], r["centre"]) for r in found):
            children[node].append(len(centres))
            fresh.append(len(centres))
            centres.append(np.array(centre))
            children.append([])
        tree = grown = Tree(np.stack(centres), children, unit, tree.longest)

        def step(batches):
            for batch in batches:
                node = grown.place(_matrix(batch.column(1), dims))
                moved = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node)], names=["vec_id", "vec", "node"])
                yield moved.filter(pa.array(np.isin(node, fresh)))

        now = stage(now.select("vec_id", "vec").mapInArrow(step, f"vec_id long, vec {kind}, node long"))


def calibrate(queries: DataFrame, placed: DataFrame, tree: Tree, dims: int, k: int, count: int = CALIBRATION, recall: float = RECALL) -> int:
    """Leaves to visit, so that ``recall`` of the exact ``k`` neighbours of ``count`` queries, picked by hash, lie in them."""
    some = queries.orderBy(_lot(1_000_003), "vec_id").limit(count).collect()                              # bounded by count
    vecs, ids = np.array([r["vec"] for r in some], float).reshape(-1, dims), np.array([r["vec_id"] for r in some], np.int64)

    def exact(batches):
        held = pd.DataFrame({"q": [], "vec_id": [], "score": [], "leaf": []}).astype({"q": int, "vec_id": int, "score": float, "leaf": int})
        for batch in batches:
            for a in range(0, len(batch), TILE_ROWS):
                part = batch.slice(a, TILE_ROWS)
                own, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                q, r, s = best_of(vecs, ids, _matrix(part.column(1), dims), own, k)
                held = pd.concat([held, pd.DataFrame({"q": q, "vec_id": own[r], "score": s, "leaf": leaf[r]})])
                held = held.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    hits = placed.select("vec_id", "vec", "leaf").mapInArrow(exact, "q long, vec_id long, score double, leaf long")
    wanted = top_k(hits, "q", k).select("q", "leaf").collect()                                            # at most count * k rows
    order = [{leaf: i for i, leaf in enumerate(seen)} for seen in tree.visits(vecs)]
    needed = np.sort([order[r["q"]][r["leaf"]] + 1 for r in wanted])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL,
            sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score, n_visits``: the ``k`` nearest rows found for every row whose id is divisible by ``every``.

    Nearness is the inner product of the given vectors in double precision, ties go to the smaller id.
    Candidates are all rows but those with the query's id; fewer than ``k`` are all returned.  Rows with a
    null id, and vectors that are null, zero, or hold null or non-finite components, take no part; equal rows
    count once, rows with one id and different vectors stay apart.  Vectors of different lengths are
    searched apart.  An empty table gives no rows.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    rows = stage(given.filter(valid_vector(F.col("vec")) & F.col("vec_id").isNotNull()).distinct())
    lengths = [r[0] for r in rows.select(F.size("vec")).distinct().limit(1001).collect()]
    if len(lengths) > 1000:
        raise ValueError("more than 1000 different vector lengths")
    results = [_search(rows.filter(F.size("vec") == d), d, every, k, recall, sample, leaf_rows) for d in sorted(lengths)]
    if not results:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("n_visits"))
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def shelves(tree: Tree, counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, shelf, tiles of the shelf): leaves in the order of the tree, a shelf is full with ``TILE_ROWS`` rows."""
    out, todo, shelf, held = [], [0], 0, 0
    while todo:
        node = todo.pop()
        todo += reversed(tree.children[node])
        n = counts.get(node, 0)
        if not n:
            continue
        if held and held + n > TILE_ROWS:
            shelf, held = shelf + 1, 0
        held += n
        out.append((node, shelf, -(-n // TILE_ROWS)))
    return out


def _search(rows: DataFrame, dims: int, every: int, k: int, recall: float, sample: int, leaf_rows: int) -> DataFrame:
    tree, kind = fit_tree(rows, dims, rows.count(), sample, leaf_rows=leaf_rows), rows.schema["vec"].dataType.simpleString()

    def put(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(_matrix(batch.column(1), dims)))], names=["vec_id", "vec", "leaf"])

    placed = stage(rows.mapInArrow(put, f"vec_id long, vec {kind}, leaf long"))
    queries = stage(rows.filter(F.col("vec_id") % every == 0).withColumn("query", F.xxhash64("vec_id", "vec")))
    visits = calibrate(queries, placed, tree, dims, k, recall=recall)

    def plan(batches):
        for batch in batches:
            seen = list(tree.visits(_matrix(batch.column(1), dims), visits))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.list_(pa.int64())), *batch.columns], names=["leaves", "vec_id", "vec", "query"])

    sent = stage(queries.select("vec_id", "vec", "query").mapInArrow(plan, f"leaves array<long>, vec_id long, vec {kind}, query long"))
    # neighbouring leaves share a shelf of about TILE_ROWS rows; one row per leaf reaches the driver, and leaves are bounded by the sample
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = rows.sparkSession.createDataFrame(shelves(tree, counts), "leaf long, shelf long, row_tiles int")
    table = stage(table)
    asks = lookup_join(sent.select("vec_id", "query", "vec", F.explode("leaves").alias("leaf")), table, ["leaf"])
    asks = stage(asks.groupBy("shelf", "vec_id", "query").agg(F.first("vec").alias("vec"), F.collect_list("leaf").alias("leaves"), F.max("row_tiles").alias("row_tiles")))
    asked = asks.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).cast("int").alias("ask_tiles"))
    asked = stage(asked)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["shelf", "ask_tile", "row_tile"]
    left = (lookup_join(asks, asked, ["shelf"]).withColumn("ask_tile", F.pmod("query", "ask_tiles").cast("int"))
            .withColumn("row_tile", each("row_tiles")).select(*keys, "vec_id", "query", "vec", "leaves"))
    right = (lookup_join(lookup_join(placed, table, ["leaf"]), asked, ["shelf"]).withColumn("row_tile", F.pmod(F.xxhash64("vec_id", "vec"), F.col("row_tiles")).cast("int"))
             .withColumn("ask_tile", each("ask_tiles")).select(*keys, "vec_id", "vec", "leaf"))

    def score(asking: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(tile):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        own, ids = asking["vec_id"].to_numpy(), tile["vec_id"].to_numpy()
        leaves, leaf = np.unique(tile["leaf"].to_numpy(), return_inverse=True)
        seen = np.zeros((len(asking), len(leaves) + 1), bool)
        for i, asked_leaves in enumerate(asking["leaves"]):
            at = np.searchsorted(leaves, asked_leaves)
            seen[i, at[leaves[np.minimum(at, len(leaves) - 1)] == asked_leaves]] = True      # a tile need not hold rows of every leaf
        q, r, s = best_of(np.stack(asking["vec"].to_numpy()).astype(float), own, np.stack(tile["vec"].to_numpy()).astype(float), ids, k, (seen, leaf))
        return pd.DataFrame({"query": asking["query"].to_numpy()[q], "query_id": own[q], "vec_id": ids[r], "score": s})

    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query long, query_id long, vec_id long, score double")
    return top_k(hits, "query", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(visits).alias("n_visits"))
