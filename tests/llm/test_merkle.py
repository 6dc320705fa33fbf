import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftlog.llm.merkle import build_manifest, document_manifest, height, missing, prove, width

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n = row[:5]
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[frame(v) for v in (i, source, lang, None if n is None else n + more, text)])


def plain_tree(leaves):
    """Levels of a tree, all nodes kept."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(by_lang[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = {x: plain_tree([leaf_of(r) for r in ordered[x]]) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for t, x in enumerate(langs):
        for p, r in enumerate(ordered[x]):
            change = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, beside = leaf_of(r, 1) if change else leaf_of(r), []
            for levels, i in ((trees[x], p), (top, t)):
                for nodes in levels[:-1]:
                    pair = [i & ~1, i | 1]
                    kids = [node if k == i else nodes[k] for k in pair if k < len(nodes)]
                    beside += [nodes[k] for k in pair if k != i and k < len(nodes)]
                    node, i = H(*kids), i >> 1
            out.append((r[0], leaf_of(r), trees[x][-1][0], root, H(*beside), node, node == root, change))
    return sorted(out, key=str)


def documents(seed, n, langs):
    rng = random.Random(seed)
    rows = [(i if rng.random() < 0.97 else None, rng.choice(["", None, "é x", "a" * 3000, f"text {i}"]), rng.choice(langs), rng.choice([None, "web", "wéb"]),
             rng.choice([None, 0, -3, i, 2 ** 63 - 1]), 1, "t") for i in range(n)]
    return rows + rows[:3] + [(5, "other text", "en", "web", 10, 1, "t")]


@pytest.mark.parametrize("n,langs,part_rows", [(1, ["en"], 4), (90, ["en", None, "de", "", "zz"], 4), (150, ["en", "en", "en", "fr"], 2), (60, [f"l{k:02d}" for k in range(40)], 8), (70, ["en", "é", "z"], 4096)])
def test_matches_plain_tree(spark, n, langs, part_rows):
    rows = documents(n, n, langs)
    got = document_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), part_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert all(r["verified"] != r["tampered"] for r in got)


def test_empty(spark):
    got = document_manifest(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[:3] == ["doc_id", "leaf", "subroot"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 13, 33])
def test_missing_nodes_are_the_fewest(n):
    """What is asked for, with the leaves, gives the top; without any one of it, it does not; nothing that follows is asked for."""
    rng = random.Random(n)
    for _ in range(20):
        held = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        asked = missing(held, n)

        def reach(extra):
            own = set(held)
            for level in range(height(n)):
                own |= {i for k, i in extra if k == level}
                own = {i >> 1 for i in own if min(i ^ 1, width(n, level) - 1) in own or i ^ 1 >= width(n, level)}
            return 0 in own

        assert reach(asked) and not any(reach([x for x in asked if x != y]) for y in asked)


def test_proof_of_some_leaves(spark):
    rows = [(i, f"t{i}", "ab"[i % 2], "s", i, 1, "t") for i in range(101)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.sha2("text", 256))
    manifest = build_manifest(df, "lang", "doc_id", part_rows=8)
    some = manifest.leaves.filter(F.col("doc_id").isin(0, 17, 18, 50, 99))
    whole = {r["doc_id"]: (r["proof_sha256"], r["folded_root"]) for r in prove(manifest, manifest.leaves).collect()}
    got = {r["doc_id"]: (r["proof_sha256"], r["folded_root"]) for r in prove(manifest, some).collect()}
    assert len(got) == 5 and all(got[i] == whole[i] and got[i][1] == manifest.root for i in got)
    assert prove(manifest, some.filter("doc_id < 0")).count() == 0
