import random

import numpy as np
import pytest

from siftlog.llm import suffixes
from siftlog.llm.suffixes import repeated_spans, without_repeats

from .brute import repeats, words

VOCAB = [f"w{i}" for i in range(400)]


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    passages = [text(n) for n in (50, 51, 64, 130, 49)]
    rows = []
    for _ in range(60):
        w = text(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
        rows.append(" ".join(w) + rng.choice(["", " ", "\n"]))
    rows += rows[:3] + [None, "", " ", "a b " * 60, "x " * 49, "É " * 55, " ".join(text(300))]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, start int").repartition(5)
    want = {i: s for i, s in repeats(rows).items() if s}
    spans = repeated_spans(df)
    assert covered(spans) == want
    assert spans.count() == sum(len([p for p in s if p - 1 not in s]) for s in want.values())


def test_text_without_repeats(spark):
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows], "doc_id long, text string, n_chars int, source string").repartition(3)
    got = {r["doc_id"]: r for r in without_repeats(df).collect()}
    hit = repeats(rows)
    for i, t in rows:
        left = [w for p, w in enumerate(words(t)) if p not in hit[i]]
        if i in got:
            assert words(got[i]["text"]) == left and got[i]["n_chars"] == len(got[i]["text"] or "")
            assert hit[i] or got[i]["text"] == t
        else:
            assert not left and hit[i]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x " * 80), (1, None), (2, "")], "doc_id long, text string")
    assert repeated_spans(df).count() == 0 and repeated_spans(df.limit(0)).count() == 0
    assert without_repeats(df.limit(0)).count() == 0


def test_two_texts_of_one_id(spark):
    """Each text keeps its own words: the other one's spans are not cut from it."""
    passage, fresh = " ".join(f"p{i}" for i in range(70)), " ".join(f"n{i}" for i in range(100))
    rows = [(1, passage), (5, "a b c " + passage + " d"), (5, fresh), (5, fresh), (7, None), (None, passage)]
    got = sorted(((r["doc_id"], r["text"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()), key=str)
    assert got == sorted([(1, passage), (5, "a b c d"), (5, fresh), (5, fresh), (7, None), (None, passage)], key=str)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_grams_send_single_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SUFFIXES", hot)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert covered(repeated_spans(df)) == {i: s for i, s in repeats(rows).items() if s}


def test_a_long_text_is_settled_in_groups(spark, monkeypatch):
    """One text with more suffixes than a task settles at once, with passages of its own again."""
    monkeypatch.setattr(suffixes, "HELD_BYTES", 20_000)
    rng = random.Random(12)
    w = [rng.choice(VOCAB) for _ in range(12_000)]
    for at in (3_000, 7_000, 11_900):
        w[at:at + 80] = w[100:180]
    rows = [(1, " ".join(w)), (2, " ".join(w[5_000:5_049])), (3, " ".join(w[5_000:5_051])), (4, "z " * 5_000)]
    got = covered(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    assert got == {i: s for i, s in repeats(rows).items() if s} and set(got) == {1, 3, 4}


def test_order_and_common_words():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (200, 6)).astype(np.uint64)
    order, common = suffixes.ordered(rows)
    assert sorted(order.tolist()) == list(range(200))
    for n in range(7):
        number = suffixes.classes(order, common, n)
        first = {}
        assert all(first.setdefault(tuple(r[:n]), k) == k for r, k in zip(rows.tolist(), number.tolist())) and len(set(number.tolist())) == len(first)
