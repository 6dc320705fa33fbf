"""Weighted density clustering and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import HOT_ROWS, lookup_join, stage
from .neighbors import TILE_ROWS, Cells, batched


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node id) for all nodes of ``edges(src, dst)``.

    Large-star and small-star rounds: every node is tied to the smallest
    neighbour it knows until nothing changes.  Hubs are safe, because minima
    are combined map-side and the join back is salted for hot nodes.
    """
    def link(pairs: DataFrame) -> DataFrame:
        return stage(pairs.filter(F.col("src") != F.col("dst"))
                     .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    e = link(edges)
    seen = mark(e)
    many = seen[0] > HOT_ROWS          # below that no node can be hot

    def tie(pairs: DataFrame, low: DataFrame) -> DataFrame:
        return lookup_join(pairs, stage(low), ["src"]) if many else pairs.join(low, "src")

    for _ in range(max_rounds):
        # large star: larger neighbours of u point to the smallest of u's neighbourhood
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("src", "_m").alias("_m"))
        large = tie(both.filter(F.col("dst") > F.col("src")), low)
        e = link(large.select(F.col("dst").alias("src"), F.col("_m").alias("dst")))
        # small star: u and its smaller neighbours point to the smallest of them
        low = e.groupBy("src").agg(F.min("dst").alias("_m"))
        small = tie(e, low)
        e = link(small.select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
                 .union(small.select("src", F.col("_m").alias("dst"))))
        now = mark(e)
        if now == seen:
            roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Ties the sets of ``a`` and ``b``; ``label`` names the smallest member of each set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label[np.maximum(x, y)] = np.minimum(x, y)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def dbscan(points: DataFrame, eps: float, min_samples: float = 4, tile_rows: int = TILE_ROWS, block_rows: int | None = None) -> DataFrame:
    """``id, cluster, core`` for weighted points ``id, w, vec``; noise is -1.

    A point is core when the weights within ε (itself included) reach
    ``min_samples``.  Clusters are the components of the core points, named by
    their smallest id; other points join the smallest cluster they touch.
    Equal vectors are one point with the sum of the weights, since they share
    their whole neighbourhood.
    """
    points = points.select("id", F.col("w").cast("double").alias("w"), F.col("vec").cast("array<float>").alias("vec"))
    merged = stage(points.groupBy("vec").agg(F.min("id").alias("id"), F.sum("w").alias("w")))
    cells = Cells(merged, eps, tile_rows, block_rows)
    limit, kind = cells.eps ** 2, cells.kind

    def ball_weight(block: pd.DataFrame, passing):
        total = np.zeros(len(block))
        for rows, near in passing:
            w = rows["w"].to_numpy()
            for r, c, _ in near(np.full(len(rows), limit), exact=False):
                total += np.bincount(r, weights=w[c], minlength=len(block))
        yield pd.DataFrame({"id": block["id"], "s": total})

    # a point as heavy as min_samples is core by itself; only light points are tested
    light = cells.homes.filter(F.col("w") < min_samples).select("id", "vec", "home")
    sums = cells.run(light, cells.homes.select("id", "w", "vec", "home"), ball_weight, f"id {kind}, s double")
    tested = sums.groupBy("id").agg(F.sum("s").alias("s")).filter(F.col("s") >= min_samples - 1e-9).select("id")
    core = stage(cells.homes.filter(F.col("w") >= min_samples).select("id").union(tested)
                 .withColumn("core", F.lit(True)))
    # ids are unique on both sides of these joins
    homes = stage(cells.homes.select("id", "vec", "home").join(core, "id", "left").na.fill({"core": False}))
    members = homes.filter("core").select("id", "vec", "home")

    def span(block: pd.DataFrame, passing):
        xi, is_core, label = block["id"].to_numpy(), block["core"].to_numpy(dtype=bool), np.arange(len(block))
        for rows, near in passing:
            yi, first = rows["id"].to_numpy(), np.full(len(rows), -1)      # the first core point of the block that each row touches

            def borders(near=near, yi=yi, first=first):
                for r, c, _ in near(np.full(len(first), limit), exact=False):
                    tied = is_core[r]
                    # a point that is not core has fewer than min_samples neighbours
                    yield xi[r[~tied]], yi[c[~tied]]
                    r, c = r[tied], c[tied]
                    new = first[c] < 0
                    first[c[new]] = r[new]
                    _unite(label, r, first[c])

            for x, y in batched(borders()):
                yield pd.DataFrame({"src": x, "dst": y, "border": True})
            met = first >= 0
            yield pd.DataFrame({"src": yi[met], "dst": xi[first[met]], "border": False})
        yield pd.DataFrame({"src": xi[is_core], "dst": xi[label[is_core]], "border": False})

    links = stage(cells.run(homes, members, span, f"src {kind}, dst {kind}, border boolean"))
    comps = connected_components(links.filter("not border").select("src", "dst"))
    solo = core.select(F.col("id").alias("node")).join(comps, "node", "left_anti").withColumn("component", F.col("node"))
    comps = stage(comps.union(solo))
    touch = links.filter("border").select(F.col("src").alias("id"), F.col("dst").alias("node")).join(comps, "node")
    border = touch.groupBy("id").agg(F.min("component").alias("cluster"))
    labels = (comps.select(F.col("node").alias("id"), F.col("component").alias("cluster"), F.lit(True).alias("core"))
              .union(border.select("id", "cluster", F.lit(False).alias("core"))))
    by_vec = merged.select("id", "vec").join(labels, "id", "left").select(
        "vec", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
    return points.select("id", "vec").join(by_vec, "vec").select("id", "cluster", "core")
