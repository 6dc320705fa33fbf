import random

import numpy as np
import pyarrow as pa
import pytest

from siftlog.llm import jaccard as J
from siftlog.llm.jaccard import jaccard_groups, size_bands
from siftlog.llm.words import ALNUM, Words, rolling, sliding

from .brute import jaccard

VOCAB = [f"w{i}" for i in range(300)]


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return w


def corpus(seed, families=40, copies=8):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([3, 5, 9, 20, 60, 200, 900]))]
        for _ in range(copies):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 12) + 1))))
    rows += ["", "   \n", None, "one", "one", "One two", "one  TWO", "é a b c d", "e a b c d"]
    return list(enumerate(rows))


def test_words_and_rolling():
    w = Words(pa.array(["Ab  c\nab", "", None, "AB", "é-x9"]), ALNUM)
    assert w.per_doc.tolist() == [3, 0, 0, 1, 2]
    assert w.hash[0] == w.hash[2] == w.hash[3] and w.hash[1] != w.hash[0]
    h = np.arange(20, dtype=np.uint64) % np.uint64(5)
    for n in (1, 2, 3, 7, 16, 20):
        r = rolling(h, n)
        assert len(r) == 21 - n and all((r[i] == r[j]) == ((i - j) % 5 == 0) for i in range(len(r)) for j in range(len(r)))
    assert len(rolling(h, 21)) == 0
    v = np.array([5, 3, 8, 1, 9, 2, 7])
    assert sliding(v, 3, np.minimum).tolist() == [3, 1, 1, 1, 2]


def test_bands_cover_all_pairs():
    bands = size_bands(85, 3000)
    lows = [b[0] for b in bands]
    home = lambda n: np.searchsorted(lows, n, side="right") - 1
    for a in range(1, 2000):
        b = 100 * a // 85
        for size in {a, b, (a + b) // 2}:
            both = -(-85 * (a + size) // 185)
            assert home(size) - home(a) in (0, 1) and a + size - 2 * both <= bands[home(a)][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, component_id string, n int")
    got = sorted(tuple(r) for r in jaccard_groups(df.repartition(3)).collect())
    assert got == jaccard(rows)


def test_large_groups_are_verified_in_blocks(spark):
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(80)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_groups(df, verify_shingles=2000).collect())
    assert got == jaccard(rows)


def test_nulls_repeats_and_empty(spark):
    long = " ".join(VOCAB)
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (7, long), (8, long)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_groups(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (7, 297, 7), (8, 297, 7)], key=str)
    assert jaccard_groups(df.limit(0)).count() == 0
    assert jaccard_groups(df.filter("doc_id = 2")).collect() == [(2, 0, 2)]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300))).astype(np.uint64) for _ in range(60)] + [np.zeros(0, np.uint64)]
    h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ds = J.band_bounds(np.array([len(s) for s in sets]), 85, 0)
    for d in (0, 7, 50):
        made = [np.frombuffer(x, np.uint8) for x in J.compact_sketches(h, doc, np.full(len(sets), d))]
        assert all(len(x) == J.BITS_PER_DIFFERENCE * d // 64 * 8 + 8 * (J.BITS_PER_DIFFERENCE * d % 64 > 0) for x in made)
        assert all(np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) for a, x in zip(sets, made) for b, y in zip(sets, made))
    assert ds[-1] == 0 and [len(x) * 8 for x in J.compact_sketches(h, doc, ds)] == [-(-3 * d // 64) * 64 for d in ds]
    bands = size_bands(85, 2000)
    for n in (0, 1, 2, 13, 400, 1999):
        home = sum(b[0] <= n for b in bands) - 1
        assert [J.band_bounds(np.array([n, 3]), 85, k)[0] for k in (0, 1)] == [bands[home - k][1] if home >= k else 0 for k in (0, 1)]


def test_texts_travel_for_verification_only(spark, monkeypatch):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    plans, stage = [], J.stage
    monkeypatch.setattr(J, "stage", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or stage(d))
    got = sorted(tuple(r) for r in jaccard_groups(df).collect())
    assert got == jaccard(rows)
    joined = [p for p in plans if any("Join" in line for line in p.splitlines()) and "text#" in p.split("Join", 1)[1] and "places#" in p]
    assert len(joined) == 1
