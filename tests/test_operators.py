"""Brute-force twins of the distributed operators, and behaviour under skew."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlog.operators import alerts as AL, cluster as CL, neighbors as NB, textvec as TV, evaluate as EV
from siftlog.functions import text as T
from siftlog.runtime import lookup_join, number_as_read, number_ordered
from siftlog.sources import sinks


def _points(spark, n=400, d=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = centres[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, d))
    v = np.vstack([v, np.repeat(v[:1], copies, 0)]) if copies else v
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    w = rng.integers(1, 3, len(v)).astype(float)
    rows = [(i, float(w[i]), v[i].tolist()) for i in range(len(v))]
    return v.astype(np.float64), w, spark.createDataFrame(rows, "id bigint, w double, vec array<float>").repartition(5)


def _distance(v):
    return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T))


def _dbscan(v, w, eps, m):
    near = _distance(v) <= eps
    core = near @ w >= m
    label = np.full(len(v), -1)
    for i in range(len(v)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.nonzero(near[todo.pop()] & core & (label < 0))[0]:
                    label[j] = i
                    todo.append(j)
    for i in range(len(v)):
        if not core[i] and (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    return label, core


@pytest.mark.parametrize("pivot_rows,tile", [(10_000, 4096), (40, 16)])
def test_dbscan_and_pairs_equal_brute_force(spark, monkeypatch, pivot_rows, tile):
    monkeypatch.setattr(NB, "ROWS_PER_PIVOT", pivot_rows)
    v, w, df = _points(spark, copies=60)
    eps = 0.25
    want, core = _dbscan(v, w, eps, 4)
    assert len(set(want)) > 3 and (want == -1).any()
    got = {r["id"]: (r["cluster"], r["core"]) for r in CL.dbscan(df, eps, 4, tile).collect()}
    assert got == {i: (int(want[i]), bool(core[i])) for i in range(len(v))}
    d = _distance(v)
    pairs = {(r["id"], r["other"]) for r in NB.eps_neighbors(df, eps, tile).collect()}
    assert pairs == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if d[i, j] <= eps}


@pytest.mark.parametrize("pivot_rows", [10_000, 40])
def test_points_travel_once_per_block(spark, monkeypatch, pivot_rows):
    """Not once per tile; blocks of any size, and a block that passing rows reach in several pieces, give the same results."""
    monkeypatch.setattr(NB, "ROWS_PER_PIVOT", pivot_rows)
    monkeypatch.setattr(NB, "STREAM_ROWS", 50)
    v, w, df = _points(spark, copies=60)
    cells = NB.Cells(df, 0.25, tile_rows=16, block_rows=100)
    assert cells.blocks.sum() <= 10
    rows = cells.homes.select("id", "vec", "home")
    passed = cells.run(rows, rows, lambda block, passing: (pd.DataFrame({"held": [len(block)], "n": [len(r)]}) for r, _ in passing), "held long, n long").collect()
    assert len(passed) > cells.blocks.sum() and max(r["held"] for r in passed) < 200
    assert len(v) <= sum(r["n"] for r in passed) <= len(v) * cells.blocks.sum()
    want, core = _dbscan(v, w, 0.25, 4)
    got = {r["id"]: (r["cluster"], r["core"]) for r in CL.dbscan(df, 0.25, 4, 16, 100).collect()}
    assert got == {i: (int(want[i]), bool(core[i])) for i in range(len(v))}
    d = _distance(v)
    pairs = {(r["id"], r["other"]) for r in NB.eps_neighbors(df, 0.25, 16, 100).collect()}
    assert pairs == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if d[i, j] <= 0.25}
    np.fill_diagonal(d, np.inf)
    near = {r["id"]: r["dist"] for r in NB.kth_distance(df, 4, 16, 100).collect()}
    assert all(abs(near[i] - np.sort(d[i])[3]) < 1e-6 for i in range(len(v)))


def test_knn_and_eps(spark):
    v, _, df = _points(spark, 200)
    d = _distance(v)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, 3]
    got = {r["id"]: r["dist"] for r in NB.kth_distance(df, 4, block=37).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(len(v)))
    assert NB.estimate_eps(df.limit(4)).first()["eps"] == 0.5


def test_knn_over_many_cells(spark, monkeypatch):
    """More points than any sample, in groups of one, few and many, against brute force."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8))
    v = np.concatenate([c + rng.normal(size=(m, 8)) * s for c, m, s in zip(centres, rng.choice([1, 3, 90, 350], 60), rng.choice([.01, .2, .6], 60))]).astype("float32")
    v = np.concatenate([v, v[:40]])                       # equal points are points
    assert len(v) > 5000
    monkeypatch.setattr(NB, "ROWS_PER_PIVOT", 250)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    a = v.astype(float)
    want = np.array([np.sort(np.delete(np.sqrt(((a - a[i]) ** 2).sum(1)), i))[3] for i in range(len(a))])
    got = {r["id"]: r["dist"] for r in NB.kth_distance(df, 4).collect()}
    assert len(got) == len(v) and all(abs(got[i] - want[i]) < 1e-5 for i in range(len(v)))
    y = np.sort(want)
    elbow = y[np.abs((y[-1] - y[0]) * np.arange(len(y)) / (len(y) - 1) - y + y[0]).argmax()]
    row = NB.estimate_eps(df, 4, lo=0.0, hi=9.0).first()
    assert row["n"] == len(v) and abs(row["eps"] - elbow) < 1e-3


def test_components_of_chain_hub_and_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 299)]
    got = {r["node"]: r["component"] for r in CL.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50)) and got[300] == got[299] == 299
    with pytest.raises(RuntimeError):
        CL.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), max_rounds=1)


def test_lookup_join_paths_agree(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, facts.join(dim, "k", how).select("id", "v").collect()))
        salted = lookup_join(facts, dim, ["k"], how, hot_rows=100, broadcast_rows=3).select("id", "v")
        assert sorted(map(str, salted.collect())) == want
        assert sorted(map(str, lookup_join(facts, dim, ["k"], how).select("id", "v").collect())) == want


def test_numbering(spark):
    df = spark.range(5000).repartition(7).withColumn("s", F.col("id") % 3)
    got = number_ordered(df, [F.desc("s"), F.asc("id")], "pos", 5).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(5000))
    assert [(r["s"], r["id"]) for r in got] == sorted(((i % 3, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    read = number_as_read(spark.range(0, 1000, 1, 6), "n", 10).collect()
    assert all(r["n"] == r["id"] + 10 for r in read)


def _one_walk(rows, cooldown, cap):
    """The gate's rules over all alerts in time order, one after the other."""
    last, sent, out = {}, {}, set()
    for app, key, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        recent = [t for t in sent.get(app, []) if ts - t < 3600]
        if cap is not None and len(recent) >= cap or ts - last.get((app, key), float("-inf")) < cooldown:
            continue
        last[app, key] = ts
        sent[app] = [*recent, ts]
        out.add(i)
    return out


@pytest.mark.parametrize("cooldown, cap", [(300.0, 6), (300.0, None), (7200.0, 3), (0.0, 5), (30.0, 1)])
def test_alert_gate_agrees_with_one_walk(spark, cooldown, cap):
    rng = np.random.default_rng(3)
    # one application owns nine tenths; busy hours, silences of an hour and exactly the cooldown
    starts = np.cumsum(rng.choice([200.0, 300.0, 3600.0, 9000.0], 150))
    rows = []
    for t in starts:
        for _ in range(int(rng.integers(1, 12))):
            app = "hot" if rng.random() < 0.9 else [None, "b"][int(rng.integers(0, 2))]
            key = None if rng.random() < 0.05 else f"k{rng.integers(0, 4)}"
            rows.append((app, key, float(t + rng.integers(0, 90)), len(rows)))
    rows += [(*r[:3], len(rows) + j) for j, r in enumerate(rows[:50])]            # repeats of one moment
    df = spark.createDataFrame(rows, "app string, key string, ts double, alert_id bigint")
    assert {r["alert_id"] for r in AL.alert_gate(df, cooldown, cap).collect()} == _one_walk(rows, max(cooldown, 1e-9), cap)


def test_alert_gate_spreads_a_hot_application(spark):
    """Nine tenths in one application with nightly silences: no span holds more than a day, and no task most of the rows."""
    day = F.floor(F.col("id") / 500)
    hot = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("app"), F.col("id") % 7)).otherwise("hot").alias("app"),
                                     F.concat(F.lit("k"), F.col("id") % 50).alias("key"),
                                     (day * 86400 + (F.col("id") % 500) * 60).cast("double").alias("ts"), F.col("id").alias("alert_id"))
    spans = AL._spans(hot, ["app"], 3600.0)
    assert spans.groupBy("app", "_span").count().agg(F.max("count")).first()[0] <= 500
    assert spans.count() == 30_000 and spans.filter("app = 'hot'").select("_span").distinct().count() == 60
    walked = AL.alert_gate(hot, 300.0, 6).collect()
    assert {r["alert_id"] for r in walked} == _one_walk([tuple(r) for r in hot.collect()], 300.0, 6)


def test_alert_gate_odd_rows(spark):
    schema = "app string, key string, ts double, alert_id bigint, _span int, extra string"
    df = spark.createDataFrame([(None, None, 5.0, 1, 1, "x"), (None, None, None, 2, 1, "x"), ("a", "", float("nan"), 3, 1, "x"), ("a", "", -10.0, 4, 1, "x")], schema)
    for cap in (30, None):
        assert {r["alert_id"] for r in AL.alert_gate(df, 300.0, cap).collect()} == {1, 4}
        assert AL.alert_gate(df.limit(0), 300.0, cap).collect() == []


def test_alert_stats(spark):
    df = spark.createDataFrame([], "app string, key string, ts double, alert_id bigint")
    storm = spark.createDataFrame([("x", "k", 1.0, i) for i in range(50)] + [("y", f"k{i}", float(i), 100 + i) for i in range(10)], df.schema)
    stats = {r["app"]: (r["sent"], r["suppressed"]) for r in AL.alert_stats(storm, AL.alert_gate(storm, max_per_hour=3)).collect()}
    assert stats == {"x": (1, 49), "y": (3, 7)}


def test_otsu_and_curve_edges(spark):
    two = spark.createDataFrame([(0.2,)] * 200 + [(0.85,)] * 200, "score double")
    assert 0.35 <= EV.otsu_threshold(two).first()["threshold"] <= 0.9
    assert EV.otsu_threshold(two.limit(2)).first()["threshold"] is None
    m = EV.prf1(spark.createDataFrame([(0, False)], "t int, p boolean"), "t", "p").first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_large_dictionary_path_agrees(spark, monkeypatch):
    msgs = spark.createDataFrame([("upstrm dbConn node42 ECONNRESET 17 Plain",), ("",), ("cfg7 HTTPServer upstrm",)], "message string")
    syn = spark.createDataFrame([("upstrm", "upstream"), ("conn", "connection"), ("node", "host"), ("cfg", "config"), ("db", "database")], "word string, replacement string")
    small = {r["message"]: r["norm"] for r in TV.with_normalized(msgs, syn).collect()}
    monkeypatch.setattr(TV, "LITERAL_SYNONYMS", 1)
    assert {r["message"]: r["norm"] for r in TV.with_normalized(msgs, syn).collect()} == small
    assert small["cfg7 HTTPServer upstrm"] == "config 7 http server upstream"


def test_normalize_words(spark):
    words = {"ECONNREFUSED": "refused", "ETIMEDOUT": "timeout", "ENOENT": "missing", "executor": "xecutor", "dbConn": "database connection", "k8s": "kubernetes"}
    df = spark.createDataFrame([(w,) for w in words], "message string")
    assert {r[0]: r[1] for r in df.select("message", T.normalize_message("message")).collect()} == words
    assert df.filter("message = 'executor'").select(T.normalize_message("message", upper_only=True)).first()[0] == "executor"


def test_delivery_counts(spark):
    def bad(row):
        raise ValueError

    got = sinks.deliver(spark.createDataFrame([(1, "m")], "alert_id bigint, message string"), {"bad": bad, "good": lambda r: None}).first()
    assert (got["sent"], got["errors"]) == (True, 1)


def test_rolling_window_larger_than_a_block(spark):
    from siftlog.operators.rolling import rolling_counts

    df = spark.createDataFrame([("a", i) for i in range(20)], "source string, pos long")
    for window in (1, 3, 4, 5, 10, 50):
        got = [r["n"] for r in rolling_counts(df, {"n": F.count(F.lit(1))}, window, block_rows=4).orderBy("pos").collect()]
        assert got == [min(i + 1, window) for i in range(20)]


def test_nothing_is_novel_to_an_empty_baseline(spark):
    from siftlog.operators.baseline import compare, novel_templates

    t = spark.createDataFrame([("ERROR", "a <*>", 4)], "lvl string, template string, cnt long")
    none = spark.createDataFrame([], "template_key string, base_count long")
    other = spark.createDataFrame([("INFO|b", 3)], "template_key string, base_count long")
    assert [r["novel"] for r in compare(t, none, F.lit(4)).collect()] == [False] and novel_templates(t, none).count() == 0
    assert [r["novel"] for r in compare(t, other, F.lit(4)).collect()] == [True] and novel_templates(t, other).count() == 1


def test_long_and_foreign_numbers_do_not_end_the_job(spark):
    from siftlog.functions.features import feature_vector
    from siftlog.functions.levels import status_level

    df = spark.createDataFrame([("99999999999", "failed after \u0661\u0662\u0663 tries"), ("404", "took 5 ms"), ("x", "")], "s string, m string")
    rows = df.select(status_level("s").alias("l"), feature_vector(F.lit("INFO"), F.lit("svc"), F.col("m")).alias("v")).collect()
    assert [r["l"] for r in rows] == ["ERROR", "INFO", "INFO"] and all(len(r["v"]) == 14 for r in rows)


def test_running_totals_equal_frames(spark):
    """One step a row whatever the window: the frame sums come from running totals; nulls count 0."""
    from siftlog.operators.rolling import rolling_counts

    df = spark.createDataFrame([(s, i, None if i % 7 == 0 else i % 3) for s in "ab" for i in range(41)], "source string, pos bigint, x int")
    for window in (1, 3, 4, 11, 100):
        got = rolling_counts(df, {"want": F.sum("x")}, window, block_rows=4, totals={"n": F.lit(1), "x_sum": F.col("x")})
        rows = got.orderBy("source", "pos").collect()
        assert len(rows) == 82 and all(r["x_sum"] == (r["want"] or 0) and r["n"] == min(window, r["pos"] + 1) for r in rows)


def test_tfidf_moves_each_document_once(spark):
    """One exchange for counts and norms; a text goes through the term pattern once; repeated and null keys as before."""
    import math

    docs = spark.createDataFrame([(1, "disk full disk full"), (2, "the disk failed"), (2, "disk"), (3, ""), (None, "disk full")], "id long, norm string")
    vocabulary = TV.fit_vocabulary(docs, TV.TextModel(min_df=1))
    assert {(r["term"], r["tf"], r["df"]) for r in vocabulary.collect()} >= {("disk", 5, 4), ("full", 3, 2), ("disk full", 3, 2), ("full disk", 1, 1), ("failed", 1, 1)}
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    out = TV.tfidf(docs, vocabulary, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id") == 1 and "SortMergeJoin" not in plan
    got = {(r["id"], r["term"]): r["weight"] for r in out.collect()}
    counts = {1: {"disk": 2, "full": 2, "disk full": 2, "full disk": 1}, 2: {"disk": 2, "failed": 1, "disk failed": 1}}
    raw = {k: {t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for k, c in counts.items()}
    want = {(k, t): v / math.sqrt(sum(x * x for x in c.values())) for k, c in raw.items() for t, v in c.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    words = spark.range(1).select(T.text_terms(F.lit("the disk is full")).alias("terms"))
    assert words._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert words.first()[0] == ["disk", "is", "full", "disk is", "is full"]


def test_features_search_a_text_once(spark):
    from siftlog.functions import fixed as X
    from siftlog.functions.base import literal_array
    from siftlog.functions.features import feature_columns
    from siftlog.functions.text import normalize_message

    texts = ["GET /a HTTP/1.1 503 after 5ms and 2 minutes", "404 Not Found", "npe7 down3 etimeout ioerror errors", "plain words",
             "7 MB at line 3", "", None, "status ٥٠٣ in ٤ min", "123abort _leak_ ENOENT econntimeout"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(texts)], "i int, m string")
    cols = feature_columns(F.lit("INFO"), F.lit("s"), F.col("m"))
    norm = normalize_message(F.lower("m"))
    whole = sum((F.coalesce(F.contains(norm, F.lit(w)).cast("int"), F.lit(0)) for w in X.FEATURE_WORDS), F.lit(0))
    rows = df.select("i", *[c.alias(n) for n, c in cols.items()], (whole / 23.0).alias("all_words")).orderBy("i").collect()
    assert [r["error_score"] for r in rows] == [r["all_words"] for r in rows]
    assert [r["http_score"] for r in rows] == [1.0, 0.5, 0, 0, 0, 0, 0, 1.0, 0]
    assert [r["has_memory"] for r in rows] == [0, 0, 0, 0, 1.0, 0, 0, 0, 0]
    assert [rows[i]["max_duration"] for i in (0, 7)] == pytest.approx([math.log1p(120) / 10, math.log1p(240) / 10])
    plan = df.select(cols["http_score"])._jdf.queryExecution().analyzed().toString()
    assert plan.count(X.HTTP_PATTERN) <= 4            # for ASCII rows and for others; nothing searches again for a second group


def test_supervised_head_moves_no_texts(spark, monkeypatch):
    from siftlog.operators import supervised as SU

    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).alias("label"), F.lit("a long text").alias("message"),
                                 *[((F.col("id") * (i + 3)) % 7 + F.col("id") % 2).cast("double").alias(c) for i, c in enumerate(SU.COLUMNS)])
    seen, real = [], SU.number_ordered
    monkeypatch.setattr(SU, "number_ordered", lambda rows, *a: seen.append(rows.columns) or real(rows, *a))
    assert SU.train_and_evaluate(df, "k", model="lr").first()["n"] == 80
    assert seen == [["k", "label", *SU.COLUMNS]]


def test_words_outside_a_large_dictionary_skip_its_map(spark):
    learned = {**T.X.BASE_SYNONYMS, **{f"word{i}": f"w{i}" for i in range(300)}, "shut": "closed"}
    df = spark.createDataFrame([("shut db7 word12 wordX npeDown plain", ), ("",), (None,)], "m string")
    out = df.select(T.normalize_message("m", learned).alias("n"))
    assert [r["n"] for r in out.collect()] == ["closed database 7 w12 word x crash unavailable plain", "", None]
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(T.normalize_message("m", {}).alias("n")).first()["n"] == "shut db 7 word 12 word x npe down plain"
