import random

import numpy as np
import pyarrow as pa
import pytest

from siftlog.llm.contamination import GAP, MATCH, MISMATCH, Items, Table, align, candidates, decontaminated, leaks
from siftlog.llm.words import ALNUM, Words

VOCAB = [f"w{i}" for i in range(500)]


def plain_align(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = max(0, t[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), t[i - 1, j] + GAP, t[i, j - 1] + GAP)
    return int(t.max())


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        score, low, high = align(a, b)
        assert score == plain_align(a, b) and (score == 0 or plain_align(a, b[low:high]) == score)


def test_alignment_of_a_very_long_passage():
    rng = np.random.default_rng(8)
    item, passage = np.arange(300), rng.integers(1000, 2000, 2_000_000)
    passage[1_500_000:1_500_300] = item
    assert align(item[:40], passage) == (80, 1_500_000, 1_500_040)
    assert align(item, passage[:0]) == (0, 0, 0) and align(item[:0], passage) == (0, 0, 0)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(12, 50)))) for i in range(30)] + [(40, None), (41, ""), (42, "short one here")]
    docs, want = [], set()
    for d in range(150):
        w = text(rng.randrange(0, 200))
        if d % 3 == 0:
            i, t = items[rng.randrange(30)]
            p = t.split()
            for _ in range(rng.randrange(0, len(p) // 8 + 1)):
                k = rng.randrange(len(p))
                p[k:k + 1] = rng.choice([[rng.choice(VOCAB)], [], [p[k], "extra"]])
            at = rng.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
            want.add((d, i))
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (502, "xx Short, ONE here! yy"), (None, items[0][1])]
    want |= {(502, 42), (None, 0)}
    return items, docs, want


@pytest.mark.parametrize("block", [2_000_000, 400])
def test_edited_copies_are_found(spark, block):
    items, docs, want = corpus(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = leaks(d, b, block_words=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    exact = [r for r in rows if r["score"] == 1.0]
    plain = {i: t for i, t in docs}
    for r in exact:
        w = plain[r["doc_id"]].lower().replace(",", "").replace("!", "").split()
        assert " ".join(w[r["first_word"]:r["last_word"] + 1]) == dict(items)[r["item_id"]]


def test_clean_texts_stay(spark):
    items, docs, want = corpus(9)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    kept = {r["doc_id"] for r in decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want if i is not None}
    assert decontaminated(d.limit(0), b).count() == 0 and decontaminated(d, b.limit(0)).count() == len(docs)


def test_every_alignment_of_the_score_is_found(spark):
    rng = random.Random(6)
    items = [(i, [rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 12, 16, 24]))]) for i in range(30)]
    texts = []
    for d in range(240):
        p = list(items[d % 30][1])
        if d % 8 == 0:
            p = [x for k, v in enumerate(p) for x in ([v] if k == 0 else [f"y{k}", v])]      # a word between all
        elif d % 8 == 1:
            p = [f"y{k}" if k % 3 == 2 else v for k, v in enumerate(p)]
        else:
            for k in rng.sample(range(len(p)), round(rng.uniform(.15, .3) * len(p))):
                p[k] = rng.choice(VOCAB)
        at = rng.randrange(30)
        w = [rng.choice(VOCAB) for _ in range(60)]
        texts.append((d, w[:at] + p + w[at:]))
    want = {(d, i) for d, w in texts for i, t in items if MATCH * sum(x in w for x in t) >= len(t) and plain_align(t, w) >= MATCH * .5 * len(t)}
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()} == want and len(want) > 200


def test_very_common_seeds(spark):
    """All words of the items stand in most texts; only texts that hold them in their order match."""
    rng = random.Random(15)
    common = [f"c{i}" for i in range(12)]
    items = [(i, [rng.choice(common) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 8, 20, 40, 40])]
    texts = []
    for d in range(120):
        w = [rng.choice(common + VOCAB) for _ in range(rng.randrange(0, 90))]
        if d % 4 == 0:
            p = [x for x in items[d // 4 % 7][1] if rng.random() > .1]
            w[10:10] = p
        texts.append((d, w))
    want = {(d, i) for d, w in texts for i, t in items if plain_align(t, w) >= len(t)}
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(d, b).collect()} == want and len(want) > 100


def test_candidates_stay_few_as_items_grow():
    """Passages to align, per text, hardly grow with the number of items."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = Words(pa.array([text(150) for _ in range(200)]), ALNUM)
    for n in (200, 2000):
        items = Items(list(range(n)), [text(30) for _ in range(n)], .5)
        seeds = items.seeds(np.zeros(len(items.gram), np.int64))
        got = candidates(texts, items, seeds, Table(seeds.gram), items.numbers(texts, Table(items.word)))
        assert len(got) <= 2
