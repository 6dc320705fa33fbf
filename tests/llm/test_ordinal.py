import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.llm.ordinal import OrdinalModel, fit, label_grades, score, train


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    n, latent = 600, rng.normal(size=600)
    grade = np.digitize(latent, [-0.7, 0.6])
    doc, f = np.repeat(np.arange(n), 2), np.tile([5, 9], n)
    x = np.stack([np.maximum(latent, 0), np.maximum(-latent, 0)], 1).ravel()
    keep = x > 0
    model = fit(doc[keep], f[keep], x[keep], grade, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.bincount(doc[keep], weights=model.weights[f[keep]] * x[keep], minlength=n))
    assert np.all(tails[:, 0] >= tails[:, 1]) and ((tails >= .5).sum(1) == grade).mean() > .9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    graded = label_grades(spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, graded.filter(~held), 3)
    rows = score(docs, model, 2).join(graded.filter(held), "doc_id").select("grade", "accepted", "expected_grade").collect()
    share = lambda g: np.mean([r["accepted"] for r in rows if r["grade"] == g])
    assert share(2) > .97 and share(1) < .2 and share(0) < .3
    mean = lambda g: np.mean([r["expected_grade"] for r in rows if r["grade"] == g])
    assert mean(0) < mean(1) < mean(2)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "?!", "c"), (4, "good words", "d"), (None, "good words", "e")], "doc_id long, text string, accepted string")
    rows = {r["doc_id"]: r["accepted"] for r in score(docs, None, 2).collect()}
    assert rows == {1: False, 2: False, 3: False, 4: True, None: True}
    model = OrdinalModel(np.zeros(1 << 16), np.array([-1.0, -0.5]))
    got = {r["doc_id"]: r for r in score(docs, model, 2).collect()}
    assert got[4]["accepted"] and got[4]["p_good"] == pytest.approx(1 / (1 + np.exp(-.5))) and got[1]["p_good"] is None
    assert score(docs.limit(0), model, 2).count() == 0
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert train(docs, none, 3) is None
    odd = spark.createDataFrame([(4, None), (4, 7), (None, 1)], "doc_id long, grade int")
    assert train(docs, odd, 3) is None


def test_repeated_ids_count_once(spark):
    texts = [(i, f"{'fine clear' if i % 2 else 'dull vague'} words") for i in range(40)]
    grades = spark.createDataFrame([(i, 1 + i % 2) for i in range(40)], "doc_id long, grade int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    often = spark.createDataFrame(texts + [(7, "zz later text")] + [texts[3]] * 500, "doc_id long, text string")
    a, b = train(once, grades, 3), train(often, grades, 3)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
