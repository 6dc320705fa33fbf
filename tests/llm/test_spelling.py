import random
import re
import zlib

import pyarrow as pa
import pytest

from siftlog.llm.spelling import Acceptor, composed, near_words, occurrences, roots, spelling_groups

from .brute import LOWER


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def plain_words(rows, slip=199, least=6):
    out = {}
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            word = run[:k] + run[k + 1:] if h % slip == 0 else run
            if len(word) >= least:
                out[word] = out.get(word, 0) + 1
    return out


def plain_groups(rows, slip=199):
    n = {w: k for w, k in plain_words(rows, slip).items() if k >= 5}
    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé÷") for _ in range(rng.choice([5, 6, 7, 8, 9]))) for _ in range(60)] + ["a" * 70, "a" * 69 + "b", "a" * 71, "Größere", "grössere"]
    rows = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = words[min(int(rng.expovariate(0.08)), len(words) - 1)]
            k = rng.randrange(len(w))
            w = rng.choice([w, w, w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + "ab"[k % 2] + w[k:], w[:k] + "b" + w[k + 1:]])
            text.append(w + rng.choice([" ", "  ", "7", "\n", "-", "ā", "’"]))
        rows.append((i, "".join(text)))
    return rows + [(None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (200, None), (201, ""), (202, "123 ā")]


@pytest.mark.parametrize("seed,slip,group", [(1, 199, 20_000), (2, 7, 20_000), (3, 3, 3)])
def test_matches_brute_force(spark, seed, slip, group):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, word string, n int")
    got = spelling_groups(df.repartition(3), slip=slip, group_words=group)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(rows, slip)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_long_run_and_long_text(spark):
    rows = [(i, ("x" * 30_000 + " ") * 2 + "filler " * 50_000) for i in range(3)] + [(9, ("x" * 30_001 + " ") * 30)]
    got = sorted(map(tuple, spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain_groups(rows)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "12 34"), (3, "short word")], "doc_id long, text string")
    assert spelling_groups(df).count() == 0 and spelling_groups(df.limit(0)).count() == 0


def test_occurrences_of_a_batch():
    words, n = occurrences([1, 2], pa.array(["Straße straße STRAßE", None]), 6, 10 ** 9)
    assert dict(zip(words.to_pylist(), n.tolist())) == {"straße": 3}


def test_acceptor_is_minimal_and_composition_complete():
    rng = random.Random(4)
    for _ in range(50):
        words = sorted({"".join(rng.choice("ab") for _ in range(4)) for _ in range(rng.randrange(1, 14))})
        longer = sorted({"".join(rng.choice("ab") for _ in range(5)) for _ in range(rng.randrange(1, 14))})
        a = Acceptor(words)

        def language(s):
            return ({""} if a.final[s] else set()) | {c + t for c, to in a.arcs[s].items() for t in language(to)}

        used, todo = set(), [a.start]
        while todo:
            s = todo.pop()
            if s not in used:
                used.add(s)
                todo += a.arcs[s].values()
        assert language(a.start) == set(words) and len({frozenset(language(s)) for s in used}) == len(used)
        assert sorted(composed(a, a, False)) == sorted((x, y) for x in words for y in words if x < y and near(x, y))
        assert sorted(composed(a, Acceptor(longer), True)) == sorted((x, y) for x in words for y in longer if near(x, y))


def test_crowded_partition_is_tiled(spark):
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(6)): rng.randrange(1, 99) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in near_words(df, group_words=7).collect()}
    for w in words:
        beside = [x for x in words if near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        assert got.get(w) == (None if best is None else (len(beside), words[best], best))


def test_roots_follow_chains(spark):
    rows = [(str(i), str(i + 1)) for i in range(20)] + [("a", "5")]
    got = dict(map(tuple, roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert set(got.values()) == {"20"} and len(got) == 21
