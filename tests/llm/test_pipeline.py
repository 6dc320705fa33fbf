import hashlib
import random

import corpus_pipeline as C
import pytest
from tokenizers import Tokenizer

from .brute import components, jaccard, repeats, shingles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, step in C.STAGES:
        from siftlog.runtime import stage

        out.append(stage(step(spark, out[-1], SF)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(outputs):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert all(o.columns == C.COLUMNS for o in outputs[:-1])


def test_quality_keeps_good_documents(spark, outputs):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(outputs[1])
    good = [i for i, v in labels.items() if v == (1, 0)]
    bad = [i for i, v in labels.items() if v != (1, 0)]
    assert sum(i in kept for i in good) >= .97 * len(good) and sum(i in kept for i in bad) <= .2 * len(bad)


def test_one_of_each_group(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    assert set(after) == {i for i, _, c in jaccard([(i, r["text"]) for i, r in before.items()]) if i == c}


def test_repeats_are_cut(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    hit = repeats([(i, r["text"]) for i, r in before.items()])
    for i, r in before.items():
        left = [w for p, w in enumerate(words(r["text"])) if p not in hit[i]]
        assert (words(after[i]["text"]) if i in after else []) == left


def test_test_items_go(spark, outputs):
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(outputs[3]), rows(outputs[4])
    whole = {i for i, r in before.items() if any(t in " ".join(words(r["text"])) for t in items if t)}
    assert not whole & set(after)
    grams = {tuple(t.split()[k:k + 8]) for t in items for k in range(len(t.split()) - 7)}
    clean = {i for i, r in before.items() if not any(tuple(words(r["text"])[k:k + 8]) in grams for k in range(len(words(r["text"])) - 7))}
    assert clean <= set(after)


def test_ids_are_those_of_the_library(outputs):
    tok = Tokenizer.from_file(C.TOKENIZER)
    before, after = rows(outputs[4]), rows(outputs[5])
    assert set(before) == set(after)
    for i, r in before.items():
        ids = tok.encode(r["text"], add_special_tokens=False).ids
        assert after[i]["n_tokens"] == len(ids) and after[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_and_near_copies_of_odd_rows(spark, outputs):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, outputs[-1].collect()))
    text = "one two three four five six seven"
    odd = spark.createDataFrame([(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, None, None, None), (None, text, "en", "s", 1), (5, None, None, None, None)],
                                outputs[0].schema)
    assert sorted((r["doc_id"] or 0) for r in C.near_copies(spark, odd, SF).collect()) == [0, 1, 5]
    assert C.near_copies(spark, odd.limit(0), SF).count() == 0


def test_near_copies_take_five_words_and_80_percent(spark, outputs):
    rng = random.Random(12)
    texts = []
    for n in (5, 30, 49, 50, 51, 52, 53, 98, 150, 300):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for changes in (0, 1, 2, 3, 5):
            w = list(base)
            for k in range(min(changes, n // 10)):
                w[(k + 1) * n // (changes + 1)] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    close = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i for i, c in components(sets, close).items() if i == c}
    assert want != {i for i, _, c in jaccard(list(enumerate(texts))) if i == c}      # the two bars differ on these texts
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], outputs[0].schema)
    assert {r["doc_id"] for r in C.near_copies(spark, docs, SF).collect()} == want


def test_encoding_has_one_python_worker_a_task(spark, outputs, monkeypatch):
    plans, stage = [], C.stage
    monkeypatch.setattr(C, "stage", lambda d: plans.append(d) or stage(d))
    plans.append(C.encoding(spark, outputs[4], SF))
    for d in plans:
        nodes = [line.lstrip(" :+-").split(" ")[0] for line in d._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        nodes = [n for n in nodes if n not in ("Project", "Filter", "Union")]
        assert ("MapInArrow", "MapInArrow") not in zip(nodes, nodes[1:])
