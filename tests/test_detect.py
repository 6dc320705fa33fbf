"""Contracts of the whole run."""

import pytest
from pyspark.sql import functions as F

from siftlog.config import OPTIONS, settings
from siftlog.operators import baseline as BL, evaluate as EV, templates as TP
from siftlog.operators.parse import parse_lines, with_format
from siftlog.plans.analyze import analyze, detect, template_vectors
from siftlog.plans.benchmark import benchmark_report
from siftlog.runtime import stage
from siftlog.sources import sinks, synthetic

FAST = settings(learn_synonyms=False)


@pytest.fixture(scope="module")
def corpus(spark):
    raw = synthetic.generate_logs(spark, 3000, anomalies=30)
    entries = parse_lines(with_format(raw.select(F.col("idx").alias("entry_id"), F.col("cluster").alias("family"), F.col("line").alias("value"))))
    return entries.withColumn("label", (F.col("family") != "normal").cast("int"))


@pytest.fixture(scope="module")
def run(spark, corpus):
    return detect(corpus, FAST)


def test_generated_corpus_floors(corpus, run):
    """Families lie closer together than apart, rare incidents stand off, and severe ones are all flagged.

    Families that are spread evenly over the file are damped as routine noise on
    purpose, so there is no floor on the share of flagged family lines.
    """
    prepared = TP.prepare(corpus)
    templates = TP.build_templates(prepared)
    vectors = template_vectors(prepared, templates, FAST)
    rows = stage(TP.with_template_id(prepared, templates).join(vectors, "template_id").select("family", "vec"))
    sep = EV.cluster_separation(rows.filter("family not in ('normal', 'anomaly')"), "family").first()
    assert sep["intra_mean"] > sep["inter_mean"] and sep["separation"] > 0
    iso = EV.isolation(rows.filter("family <> 'normal'"), F.col("family") == "anomaly", "family").first()
    assert iso["isolation"] > 0.1
    m = EV.prf1(run.scored, "label", "flagged").first()
    assert m["n"] == 3000 and m["tp"] > 0
    assert run.scored.filter("level = 'CRITICAL' and not flagged").count() == 0


def test_scores_are_bounded_and_reports_fit(run):
    r = run.scored.agg(F.min("score"), F.max("score"), F.count_if(F.size("reasons") != F.size("reason_codes"))).first()
    assert 0.0 <= r[0] and r[1] <= 1.0 and r[2] == 0
    s = run.summary().first()
    assert s["entries"] == 3000 and s["anomalies"] == run.scored.filter("flagged").count() and s["clusters"] > 1
    assert run.groups.agg(F.sum("cnt")).first()[0] == s["anomalies"]
    assert run.families().agg(F.sum("cnt")).first()[0] == s["anomalies"]
    assert run.meta().first()["eps"] == run.eps and 0.15 <= run.eps <= 0.9
    assert run.incident().first()["incident_mode"]
    assert "Total anomalies" in run.digest("x").first()["digest"]


def test_hard_flag_baseline_and_sensitivity(spark):
    rows = [(i, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "INFO", "s", f"served request {i}") for i in range(200)]
    rows += [(200, "2024-01-01T00:04:00Z", "FATAL", "s", "gone"), (201, "2024-01-01T00:04:01Z", "WARN", "s", "brand new notice")]
    e = spark.createDataFrame(rows, "entry_id bigint, ts_raw string, level string, service string, message string")
    base = BL.build_baseline(TP.prepare(e.filter("entry_id < 150")))
    d = detect(e, FAST, base)
    got = {r["entry_id"]: r for r in d.scored.filter("entry_id >= 199").collect()}
    assert got[200]["score"] > 0.99 * 0.8 and got[200]["flagged"] and "hard" in got[200]["reason_codes"]
    assert "novel" in got[201]["reason_codes"] and got[201]["flagged"] and not got[199]["flagged"]


def test_settings_reach_their_parts():
    s = settings("high", eps=0.3, rare_min=7, burst_window=30.0, text_features=64, flood_share=None, not_an_option=1)
    assert (s.threshold, s.radius, s.rarity.least, s.bursts.width, s.text.size, s.volumes.flood) == (0.60, 0.3, 7, 30.0, 64, 0.20)
    assert settings("unheard of") == settings() and settings("low", flag_threshold=0.5).threshold == 0.5
    for part, key in OPTIONS.values():
        assert hasattr(getattr(s, part) if part else s, key)


def test_analyze_lines_and_write(spark, tmp_path):
    lines = [f"2024-01-01T00:00:{i % 60:02d}Z INFO [api] request completed {i}ms" for i in range(40)]
    lines += ["2024-01-01T00:01:00Z FATAL [db] disk lost"] + [f"2024-01-01T00:01:{i:02d}Z ERROR [db] connection refused {i}" for i in range(10)]
    d = analyze(spark, lines=lines, learn_synonyms=False)
    assert d.n == 51
    top = d.anomalies.orderBy("rank_id").first()
    assert top["level"] == "FATAL"
    sinks.write_results(d.scored, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 51 and "source" in back.columns


def test_benchmark_gate(spark, corpus):
    with pytest.raises(ValueError, match="rename"):
        detect(corpus.withColumn("score", F.lit(1.0)))
    with pytest.raises(ValueError, match="below"):
        benchmark_report(corpus.filter("entry_id < 400"), FAST, min_f1=1.01)
