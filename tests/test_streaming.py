"""Streams on small directories, compared with their batch twins or their contracts."""

import pytest
from pyspark.sql import functions as F

from siftlog import settings
from siftlog.operators.alerts import alert_gate, delivery_stats
from siftlog.operators.lines import merge_multiline
from siftlog.streaming import alerts as SA, live, multiline
from siftlog.streaming.ledger import Ledger


def _files(spark, rows, schema, path, parts):
    """Write rows as ``parts`` parquet files, one after the other in time."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(df, spark, until):
    """For operators with processing-time timers: such a query has no natural end, so wait for its rows."""
    import time

    q = df.writeStream.outputMode("append").format("memory").queryName("out").trigger(processingTime="1 second").start()
    end = time.time() + 40
    while time.time() < end and not until(spark.table("out")):
        time.sleep(0.5)
    q.stop()
    return spark.table("out")


def _run(df, spark, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


def _entries():
    rows = [(f"2024-01-01T00:00:{i % 60:02d}Z", "INFO", "svc", f"request completed {i}ms") for i in range(60)]
    rows.append(("2024-01-01T00:01:00Z", "FATAL", "db", "disk controller lost"))
    rows += [(f"2024-01-01T00:01:{i % 60:02d}Z", "ERROR", "db", f"connection refused to 10.0.0.{i}") for i in range(20)]
    return rows


def test_immediate_and_level_counts(spark, tmp_path):
    schema = "ts_raw string, level string, service string, message string"
    stream = _files(spark, _entries(), schema, str(tmp_path / "in"), 2)
    out = _run(live.immediate(stream), spark).collect()
    assert [(r["level"], r["score"]) for r in out] == [("FATAL", 1.0)]
    counts = _run(live.level_counts(stream), spark, "complete")
    assert {r["level"]: r["cnt"] for r in counts.collect()} == {"INFO": 60, "ERROR": 20, "FATAL": 1}
    row = live.incident_from_counts(counts).first()
    assert row["entries"] == 81 and not row["incident"]


def test_rates_match_batch(spark, tmp_path):
    schema = "ts_raw string, level string, service string, message string"
    stream = _files(spark, _entries(), schema, str(tmp_path / "in"), 1)
    got = {(r["start"].minute, r["sev"]): r["cnt"] for r in _run(live.rates(stream, 2024), spark, "complete").collect()}
    assert got == {(0, 6): 60, (1, 1): 1, (1, 3): 20}


def test_live_detector_reports_once(spark, tmp_path):
    schema = "ts_raw string, level string, service string, message string"
    stream = _files(spark, _entries(), schema, str(tmp_path / "in"), 2)
    det = live.LiveDetector(str(tmp_path / "state"), str(tmp_path / "sink"), window=200, min_window=5, cfg=settings(learn_synonyms=False))
    det.start(stream, str(tmp_path / "cp"), availableNow=True).awaitTermination(240)
    det.flush(spark, 2)
    row = det.summary(spark).first()
    assert (row["entries"], row["rescore_errors"], row["anomalies"], row["by_level"]) == (81, 0, 21, {"ERROR": 20, "FATAL": 1})
    assert not row["incident"] and row["window"] == 81
    rows = det.anomalies(spark).collect()
    seqs = [r["seq"] for r in rows]
    assert len(seqs) == len(set(seqs))
    levels = [r["level"] for r in rows]
    assert levels.count("FATAL") == 1 and levels.count("ERROR") == 20 and "INFO" not in levels
    # a batch that runs again writes the same rows
    again = spark.read.schema(schema).parquet(str(tmp_path / "in")).limit(0)
    det.process(again, 3)
    assert det.anomalies(spark).count() == len(rows)


def test_rescore_waits_for_its_count_and_survives_a_restart(spark, tmp_path, monkeypatch):
    """A rescore after every 20 entries: single entries wait in the state, also across a new detector."""
    schema = "ts_raw string, level string, service string, message string"
    scored = []
    monkeypatch.setattr(live.LiveDetector, "_rescore", lambda self, rows: (scored.append(rows.count()), 1 / 0))
    new = lambda: live.LiveDetector(str(tmp_path / "state"), str(tmp_path / "sink"), window=25, min_window=5, rescore_every=20, rescore_seconds=1e9)
    batches = [8, 8, 4, 19, 1]
    for i, n in enumerate(batches):
        new().process(spark.createDataFrame(_entries()[:n], schema), i)
    assert scored == [20, 26] and new().summary(spark).first()["window"] == 25
    new().process(spark.createDataFrame(_entries()[:1], schema), 4)         # the last batch runs again
    assert scored == [20, 26, 26] and new().summary(spark).first()["entries"] == 40
    import os
    assert sorted(n for n in os.listdir(tmp_path / "state/window") if n[0] != ".") == ["batch=3", "batch=4"]


def test_callback_outcomes_are_kept_and_not_repeated(spark, tmp_path):
    schema = "ts_raw string, level string, service string, message string"
    log = str(tmp_path / "calls")

    def callback(row):
        with open(log, "a") as f:
            f.write(f"{row['seq']}\n")
        if row["message"] == "bad":
            raise OSError("down")

    det = live.LiveDetector(str(tmp_path / "state"), str(tmp_path / "sink"), min_window=1000, on_anomaly=callback, tries=2)
    rows = spark.createDataFrame([("", "FATAL", "db", "good"), ("", "FATAL", "db", "bad"), ("", "INFO", "db", "fine")], schema)
    det.process(rows, 0)
    got = {r["seq"]: (r["sent"], r["tries"], r["error"]) for r in det.ledger.outcomes(spark).collect()}
    assert got == {0: (True, 1, None), 1: (False, 2, "OSError: down")}
    det.process(rows, 0)                                   # a repeated batch offers only what failed
    assert sorted(open(log).read().split()) == ["0"] + ["1"] * 4
    assert {r["seq"]: (r["sent"], r["errors"]) for r in det.ledger.deliveries(spark).collect()} == {0: (True, 0), 1: (False, 2)}


def test_delivery_stats_count_channels(spark, tmp_path):
    alerts = spark.createDataFrame([("a", f"k{i}", float(i), i) for i in range(6)] + [(None, "k", 0.0, 10), (None, "k", 1.0, 11)],
                                   "app string, key string, ts double, alert_id bigint")

    def bad(row):
        raise ValueError("no")

    def picky(row):
        if row["alert_id"] == 1:
            raise ValueError("not this one")

    passed = alert_gate(alerts, max_per_hour=4)
    ledger = Ledger(str(tmp_path / "ledger"))
    ledger.offer(passed, {"bad": bad, "picky": picky}, 0)
    got = {r["app"]: tuple(r)[1:] for r in delivery_stats(alerts, passed, ledger.deliveries(spark)).collect()}
    assert got["a"] == (6, 3, 2, 5)


def test_failed_rescore_is_counted(spark, tmp_path, monkeypatch):
    det = live.LiveDetector(str(tmp_path / "state"), str(tmp_path / "sink"), min_window=1)
    monkeypatch.setattr(live, "detect", lambda *a, **k: 1 / 0)
    det.process(spark.createDataFrame(_entries(), "ts_raw string, level string, service string, message string"), 0)
    assert det.summary(spark).first()["rescore_errors"] == 1
    assert "division by zero" in spark.read.parquet(str(tmp_path / "state/errors")).first()["error"]
    assert [r["level"] for r in det.anomalies(spark).collect()] == ["FATAL"]


def test_multiline_stream_equals_batch(spark, tmp_path):
    text = ["2024 start", "  at a.b.C", "Caused by: x", "", "next", "... 3 more", "last"]
    rows = [("s", i, t) for i, t in enumerate(text)] + [("t", 0, "  indented first"), ("t", 1, "at once"), ("t", 2, "plain")]
    schema = "source string, line_no bigint, value string"
    batch = {(r["source"], r["line_no"]): list(r["more"]) for r in merge_multiline(spark.createDataFrame(rows, schema), 3).collect()}
    stream = _files(spark, rows, schema, str(tmp_path / "in"), 2)
    got = {(r["source"], r["line_no"]): list(r["more"]) for r in _drain(multiline.merge_stream(stream, 600_000), spark, lambda t: t.count() == len(batch) - 2).collect()}
    # the last entry of each source is still open
    assert got == {k: v for k, v in batch.items() if k not in {("s", 6), ("t", 2)}}
    # silent sources release it
    done = _drain(multiline.merge_stream(stream, 1), spark, lambda t: t.count() == len(batch))
    assert {(r["source"], r["line_no"]): list(r["more"]) for r in done.collect()} == batch


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [("a", f"k{i % 3}", float(i * 50), i) for i in range(60)] + [("b", "k", 0.0, 100 + i) for i in range(50)]
    schema = "app string, key string, ts double, alert_id bigint"
    want = {r["alert_id"] for r in alert_gate(spark.createDataFrame(rows, schema), max_per_hour=5).collect()}
    stream = _files(spark, rows, schema, str(tmp_path / "in"), 3)
    got = {r["alert_id"] for r in _drain(SA.gate_stream(stream, max_per_hour=5), spark, lambda t: t.count() >= len(want)).collect()}
    assert got == want and 100 in got and 101 not in got


def test_alert_sink_isolates_channels(spark, tmp_path):
    rows = [("a", f"k{i}", float(i), i) for i in range(10)]
    schema = "app string, key string, ts double, alert_id bigint"
    stream = _files(spark, rows, schema, str(tmp_path / "in"), 1)

    def broken(row):
        raise OSError("down")

    q = SA.alert_sink(SA.gate_stream(stream, max_per_hour=3), str(tmp_path / "t"), {"broken": broken, "ok": lambda row: None},
                      str(tmp_path / "cp"), processingTime="1 second")
    import os
    import time

    end = time.time() + 40
    while time.time() < end and not os.path.exists(tmp_path / "t/delivery/batch=0/_SUCCESS"):
        time.sleep(0.5)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "t/delivery")).agg(F.count_if("sent").alias("s"), F.count_if(~F.col("sent")).alias("e")).first()
    assert (got["s"], got["e"]) == (3, 3)
