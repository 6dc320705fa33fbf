import numpy as np
import pytest

from siftlog.llm.nearest import best_of, k_means, nearest


def exact(rows, k=20, every=20):
    """{query: [(id, score), ...]} over distinct rows with usable vectors."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)})
    out = {}
    for i, v in rows:
        if i % every == 0:
            all_ = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in all_[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(got) + 1
        got.append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def as_rows(x):
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.1 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 1, size=(3000, 1))
    rows = as_rows(x.astype(np.float32))
    df = spark.createDataFrame([(v, i, 1.0, 2) for i, v in rows], "embedding array<float>, vec_id long, score double, rank int")
    out = nearest(df, leaf_rows=64).cache()
    got, want = found(out), exact(rows)
    assert out.columns == ["query_id", "rank", "vec_id", "score", "n_visits"] and set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0])) and q not in {i for i, _ in hits}
        assert all(abs(s - float(np.dot(np.array(rows[q][1]), np.array(rows[i][1])))) < 1e-9 for i, s in hits)


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = as_rows(x)
    got, want = found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=32)), exact(rows)
    assert [i for i, _ in got[0]] == list(range(3, 63, 3)) and [i for i, _ in got[60]] == list(range(0, 60, 3))
    assert recall(got, want) >= 0.9


def test_odd_input(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, float("nan")]),
            (6, [1.0, float("inf")]), (7, [1.0, None]), (None, [9.0, 9.0]), (8, [-1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(nearest(df)) == {0: [(1, 2.0), (2, 2.0), (20, 0.5), (8, -1.0)], 20: [(1, 1.0), (2, 1.0), (0, 0.5), (8, -0.5)]}
    assert nearest(df.limit(0)).count() == 0 and nearest(df.filter("vec_id = 4")).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e300, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in found(nearest(huge))[0]] == [1, 2]


def test_ties_and_own_id():
    vecs = np.array([[1.0, 0], [1, 0], [1, 0], [0.5, 0]])
    q, r, s = best_of(np.array([[1.0, 0], [2.0, 0]]), np.array([7, 99]), vecs, np.array([9, 7, 8, 1]), 2)
    assert r.tolist() == [2, 0, 1, 2] and q.tolist() == [0, 0, 1, 1] and s.tolist() == [1, 1, 2, 2]
    assert len(k_means(np.ones((50, 3)), 4)) == 1
