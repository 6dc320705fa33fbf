"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf; the leaves of one group, in the order of their ids, form a tree, and
the tops of all trees, in the order of the groups, form the top tree, whose own top is the root.

Leaves are kept in parts of about ``part_rows`` consecutive leaves.  A part
closes its own nodes up to its height; the nodes left over are the leaves of the next tier, which
has ``part_rows`` times fewer, so a tree over 10^12 leaves needs three or four tiers.

A proof of many leaves is made part by part: a part works out which coordinates
it cannot derive from its own leaves (the smallest union over all its leaves: no node
is named twice, none that follows from others), all parts fetch theirs in one join,
and each derives the shared interiors once and unfolds the proof of every leaf from them.

Skew: a group that owns most rows is many parts, many tiny groups share one.
The nodes near the root are wanted by every part; they are few and the join
broadcasts them or salts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import lookup_join, number_ordered, stage

PART_ROWS = 4096              # leaves of a part, a power of two
TOP = -1                      # number of the tree over the tops of all others
NODES = "tree long, level int, idx long, digest binary"


def framed(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def joined(a: bytes, b: bytes = b"") -> bytes:
    """Digest over one or two digests, all as hex text."""
    return sha256(a + b).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return max(0, int(n) - 1).bit_length()


def _height(n: str) -> Column:
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0)


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    return -(-n >> level) if n else 0


def closed(level: dict[int, bytes], first: int, n: int, top: int) -> Iterator[tuple[int, dict[int, bytes]]]:
    """Levels from ``first`` + 1 up to ``top`` that follow from ``level``, whose pairs are whole."""
    for at in range(first + 1, top + 1):
        last = width(n, at - 1) - 1
        level = {i >> 1: joined(level[i], level[i + 1]) if i < last else joined(level[i]) for i in sorted(level) if not i & 1}
        yield at, level


def missing(held: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The fewest (level, index) that, with the leaves at ``held``, give the top of a tree with ``n`` leaves."""
    out, own = [], np.unique(held)
    for level in range(height(n)):
        beside = own ^ 1
        lack = beside[(beside < width(n, level)) & ~np.isin(beside, own)]
        out += [(level, int(i)) for i in lack]
        own = np.unique(own >> 1)
    return out


def interiors(leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], n: int) -> list[dict[int, bytes]]:
    """Known nodes of every level, from the leaves held and the nodes fetched."""
    levels, own = [], dict(leaves)
    by_level: dict[int, dict[int, bytes]] = {}
    for (level, i), digest in fetched.items():
        by_level.setdefault(level, {})[i] = digest
    for level in range(height(n) + 1):
        own |= by_level.get(level, {})
        levels.append(own)
        if level < height(n):
            last = width(n, level) - 1
            own = {i >> 1: joined(own[i], own[i + 1]) if i < last else joined(own[i]) for i in own if not i & 1}
    return levels


def path(levels: list[dict[int, bytes]], i: int) -> list[tuple[bytes | None, bool]]:
    """(sibling or None, whether it stands to the left) from the leaf at ``i`` to the top."""
    return [(nodes.get((i >> k) ^ 1), bool(i >> k & 1)) for k, nodes in enumerate(levels[:-1])]


def folded(leaf: bytes, proof: list[tuple[bytes | None, bool]]) -> bytes:
    for beside, left in proof:
        leaf = joined(leaf) if beside is None else joined(beside, leaf) if left else joined(leaf, beside)
    return leaf


class Manifest:
    """``leaves`` (tree, pos, n, part and the columns given), ``nodes`` (tree, level, idx, digest), ``trees``; ``root`` is hex, None without leaves."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, trees: DataFrame, tops: int, root: str | None):
        self.leaves, self.nodes, self.trees, self.tops, self.root = leaves, nodes, trees, tops, root


def _part(pos: str, part_rows: int) -> Column:
    """Number of the part of a leaf: a part of one tree begins at a multiple of its size, and belongs where its first leaf falls."""
    return F.floor((F.col("first") + F.col(pos) - F.col(pos) % part_rows) / part_rows).cast("long")


def build_manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", part_rows: int = PART_ROWS) -> Manifest:
    """The tree of ``rows``, which hold their digests (hex) in ``leaf``; other columns stay, but for those named
    like the manifest's own: tree, pos, n, first, part.

    Groups come in the order of their UTF-8 bytes, null first; leaves of a group by ``order``,
    null first, equal ones by digest.  Each two consecutive nodes, or the last one alone, become one.
    """
    if part_rows & (part_rows - 1) or part_rows < 2:
        raise ValueError("part_rows must be a power of two")
    keyed = rows.drop("tree", "pos", "n", "first", "part").withColumn("_none", F.col(group).isNull()).withColumn("_key", F.coalesce(F.col(group).cast("string"), F.lit("")))
    placed = stage(number_ordered(keyed, [F.col("_none").desc(), F.col("_key"), F.col(order).asc_nulls_first(), F.col(leaf)], "_place"))
    groups = placed.groupBy("_none", "_key").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    trees = stage(number_ordered(groups, [F.col("first")], "tree"))
    leaves = lookup_join(placed, trees, ["_none", "_key"]).withColumn("pos", F.col("_place") - F.col("first"))
    leaves = stage(leaves.withColumn("part", _part("pos", part_rows)).drop("_none", "_key", "_place"))
    tops = trees.count()
    base = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.unhex(leaf).alias("digest"))
    low, ends = _levels(leaves.select("tree", "pos", "n", "part", F.unhex(leaf).alias("digest"), "first"), part_rows)
    high = stage(ends.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(tops).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), "digest"))
    above, end = _levels(high.withColumn("part", _part("pos", part_rows)), part_rows)
    over = high.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest").unionByName(above)
    top = end.select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, base.unionByName(low).unionByName(over), trees, tops, top[0] if top else None)


def _levels(leaves: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """All nodes above ``leaves`` (tree, pos, n, part, digest, first), and the tops of the trees.

    Tier by tier: each has ``part_rows`` times fewer leaves than the one below.
    """
    step, done, out = height(part_rows), 0, None
    tops = leaves.filter("n = 1").select("tree", "digest")

    def close(part: pd.DataFrame) -> pd.DataFrame:
        cols: dict[str, list] = {"tree": [], "level": [], "idx": [], "digest": [], "n": [], "first": []}
        part = part.sort_values(["tree", "pos"])
        for (tree, n, first), own in part.groupby(["tree", "n", "first"], sort=False):
            level = dict(zip(own["pos"].tolist(), [bytes(d).hex().encode() for d in own["digest"]]))
            for at, level in closed(level, 0, int(n), min(step, height(n))):
                cols["tree"] += [tree] * len(level)
                cols["level"] += [at] * len(level)
                cols["idx"] += list(level)
                cols["digest"] += [bytes.fromhex(d.decode()) for d in level.values()]
                cols["n"] += [n] * len(level)
                cols["first"] += [first] * len(level)
        return pd.DataFrame(cols)

    while True:
        tier = stage(leaves.groupBy("part").applyInPandas(close, NODES + ", n long, first long"))
        found = tier.select("tree", (F.col("level") + done).cast("int").alias("level"), "idx", "digest")
        out = found if out is None else out.unionByName(found)
        tops = tops.unionByName(tier.filter((F.col("n") <= part_rows) & (F.col("level") == _height("n"))).select("tree", "digest"))
        left = tier.filter((F.col("level") == step) & (F.col("n") > part_rows)).select(
            "tree", F.col("idx").alias("pos"), F.ceil(F.col("n") / part_rows).alias("n"), F.floor(F.col("first") / part_rows).alias("first"), "digest")
        if left.isEmpty():
            return out, tops
        leaves, done = left.withColumn("part", _part("pos", part_rows)), done + step


def prove(manifest: Manifest, wanted: DataFrame, leaf: str = "leaf", claimed: str | None = None) -> DataFrame:
    """``wanted`` (rows of ``manifest.leaves``) with ``subroot``, ``proof_sha256``, ``folded_root`` and ``n_siblings``.

    ``proof_sha256`` is the digest of the siblings from the leaf to the root, in a pair the one that is
    not on the way, none where a node stands alone.  ``folded_root`` is what the
    proof gives from the digest in ``claimed`` (or from the leaf itself).
    """
    tops, claimed = manifest.tops, claimed or leaf

    def lacking(part: pd.DataFrame) -> pd.DataFrame:
        own = [(tree, level, i) for tree, x in part.groupby("tree", sort=False) for level, i in missing(x["pos"].to_numpy(), int(x["n"].iloc[0]))]
        own += [(TOP, level, i) for level, i in missing(part["tree"].to_numpy(), tops)]
        return pd.DataFrame({"part": part["part"].iloc[0], "tree": [o[0] for o in own], "level": [o[1] for o in own], "idx": [o[2] for o in own]})

    def unfold(part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return part.assign(subroot=[], proof_sha256=[], folded_root=[], n_siblings=[])
        fetched: dict[int, dict] = {}
        for tree, level, i, digest in zip(nodes["tree"], nodes["level"], nodes["idx"], nodes["digest"]):
            fetched.setdefault(int(tree), {})[int(level), int(i)] = bytes(digest).hex().encode()
        own, above = {}, {}
        for tree, x in part.groupby("tree", sort=False):
            leaves = {p: d.encode() for p, d in zip(x["pos"].tolist(), x[leaf])}
            own[tree] = interiors(leaves, fetched.get(tree, {}), int(x["n"].iloc[0]))
            above[tree] = own[tree][-1][0]
        upper = interiors(above, fetched.get(TOP, {}), tops)
        rest = {tree: path(upper, tree) for tree in own}
        proofs, roots, counts = [], [], []
        for tree, pos, digest in zip(part["tree"].tolist(), part["pos"].tolist(), part[claimed]):
            proof = path(own[tree], pos) + rest[tree]
            beside = [s for s, _ in proof if s is not None]
            proofs.append(sha256(b"".join(beside)).hexdigest())
            roots.append(folded(digest.encode(), proof).decode())
            counts.append(len(beside))
        return part.assign(subroot=[above[t].decode() for t in part["tree"]], proof_sha256=proofs, folded_root=roots, n_siblings=counts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    asked = stage(wanted.select("part", "tree", "pos", "n").groupBy("part").applyInPandas(lacking, "part long, tree long, level int, idx long"))
    lowest = asked.filter(F.col("tree") != TOP).agg(F.min("level")).first()[0]           # with all leaves at hand only nodes that end a part are wanted
    nodes = manifest.nodes.filter((F.col("tree") == TOP) | (F.col("level") >= (height(1 << 62) if lowest is None else lowest)))
    got = lookup_join(asked, nodes, ["tree", "level", "idx"])
    return (wanted.groupBy("part").cogroup(got.groupBy("part"))
            .applyInPandas(unfold, kinds + ", subroot string, proof_sha256 string, folded_root string, n_siblings int"))


def document_manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tampered`` for every row of ``docs``.

    A leaf covers doc_id, source, lang, n_chars and text.  Trees are per lang in the order of
    doc_id; equal ids come by digest, null ids first, and equal rows are leaves of their own.  Where 7
    divides the crc32 of the decimal doc_id, the row is checked with n_chars + 1: it must fail,
    unless n_chars is null, which stays.  A null id is never tampered with.  Null and
    empty values differ in their digest.  Other columns are ignored, an empty table gives no rows.
    """
    number = F.col("n_chars").cast("decimal(20,0)")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    columns = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    rows = docs.select("doc_id", "lang", leaf_digest(columns(F.col("n_chars"))).alias("leaf"),
                       F.when(changed & number.isNotNull(), leaf_digest(columns(number + 1))).alias("other"))
    manifest = build_manifest(rows, "lang", "doc_id", part_rows=part_rows)
    leaves = manifest.leaves.withColumn("claimed", F.coalesce("other", "leaf"))
    proved = prove(manifest, leaves.select("part", "tree", "pos", "n", "doc_id", "leaf", "claimed"), claimed="claimed")
    root = F.lit(manifest.root).cast("string")
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"), (F.col("claimed") != F.col("leaf")).alias("tampered"))
