"""Live detection: immediate surfacing, rolling rescoring, stream tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..functions import fixed as X
from ..functions.levels import is_benign_live, severity
from ..functions.times import parse_timestamp
from ..operators.parse import parse_lines, with_format
from ..plans.analyze import detect
from ..runtime import drop_folder, number_as_read, stage
from .ledger import ERROR_CHARS, Ledger


def immediate(entries: DataFrame) -> DataFrame:
    """Entries of severity 0–2 with the score they are reported with at once; stateless, so it works on streams."""
    sev = severity("level")
    return (entries.filter(sev <= 2)
            .withColumn("score", F.when(sev <= X.HARD_FLAG_SEVERITY, F.lit(1.0)).otherwise(F.lit(0.95)))
            .withColumn("reasons", F.array(F.concat(F.upper("level"), F.lit(" severity — surfaced immediately")))))


def parsed_stream(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """Streaming lines (``source, value``) → entries, each line in its own format; stateless."""
    lines = with_format(lines) if fmt is None else lines.withColumn("format", F.lit(fmt))
    return parse_lines(lines)


def level_counts(entries: DataFrame) -> DataFrame:
    """Cumulative counts by level of the whole stream (complete or update mode)."""
    return entries.groupBy(F.upper("level").alias("level")).agg(F.count(F.lit(1)).alias("cnt"), F.first(severity("level")).alias("sev"))


def incident_from_counts(counts: DataFrame, share: float = 0.30) -> DataFrame:
    """One row from a level-count table: entries, severe share, incident flag."""
    row = counts.agg(F.sum("cnt").alias("entries"), F.sum(F.when(F.col("sev") <= 3, F.col("cnt")).otherwise(0)).alias("severe"))
    s = F.when(F.col("entries") > 0, F.col("severe") / F.col("entries")).otherwise(0.0)
    return row.select("entries", s.alias("severe_share"), (s >= share).alias("incident"))


def rates(entries: DataFrame, year: int, late: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """Entries per severity and minute in event time, with a watermark for late lines."""
    stamped = entries.withColumn("event_time", F.timestamp_micros((parse_timestamp("ts_raw", year) * 1000000).cast("bigint")))
    return (stamped.withWatermark("event_time", late)
            .groupBy(F.window("event_time", width).alias("w"), severity("level").alias("sev"))
            .agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "sev", "cnt"))


ENTRY = ["ts_raw", "level", "service", "message"]


class LiveDetector:
    """Rescoring of the last ``window`` entries with exactly-once reporting.

    Used as the ``foreachBatch`` function of one stream of entries.  Urgent
    entries are reported with their batch.  The window is rescored at the end of
    a batch when ``rescore_every`` entries came or ``rescore_seconds`` passed
    since the last time, and holds ``min_window`` entries.

    The state after micro-batch b lies in ``<state>/window/batch=b`` and
    ``<state>/progress/batch=b`` (one row of counts); the rows reported by b lie
    in ``<sink>/batch=b``.  All are overwritten when b runs again, so a repeated
    batch repeats its rows and nothing is reported twice; a restarted query goes
    on from there.  State before b - 1 is removed.  Failed rescores are rows of
    ``<state>/errors``, outcomes of ``on_anomaly`` rows of the ledger
    ``<state>/ledger``.  A batch larger than the window is scored whole and then
    trimmed.
    """

    def __init__(self, state: str, sink: str, window: int = 500, min_window: int = 10,
                 cfg: Settings = Settings(), suppress_info: bool = True, on_anomaly=None,
                 rescore_every: int = 50, rescore_seconds: float = 3.0, tries: int = 1):
        self.state, self.sink = state.rstrip("/"), sink.rstrip("/")
        self.window, self.min_window, self.cfg = window, min_window, cfg
        self.suppress_info, self.on_anomaly, self.tries = suppress_info, on_anomaly, tries
        self.rescore_every, self.rescore_seconds = max(1, min(rescore_every, window)), rescore_seconds
        self.ledger = Ledger(f"{self.state}/ledger", "seq")

    def start(self, entries: DataFrame, checkpoint: str, **trigger):
        return (entries.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "3 seconds"})).start())

    def _previous(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        return spark.read.parquet(f"{self.state}/window/batch={batch_id - 1}")

    def _progress(self, spark: SparkSession, batch_id: int) -> dict:
        if batch_id == 0:
            return {"entries": 0, "severe": 0, "since": 0, "rescored_at": time.time(), "rescore_errors": 0, "window": 0}
        return spark.read.parquet(f"{self.state}/progress/batch={batch_id - 1}").first().asDict()

    def process(self, batch: DataFrame, batch_id: int, force: bool = False) -> None:
        spark = batch.sparkSession
        before, past = self._previous(spark, batch_id), self._progress(spark, batch_id)
        first = past["entries"]
        new = number_as_read(batch.select(*ENTRY), "seq", first).withColumn("reported", F.lit(False))
        rows = new if before is None else before.select(*new.columns).unionByName(new)

        urgent = immediate(new).select("seq", *ENTRY, "score", "reasons")
        fresh = F.col("seq") >= F.lit(first)
        rows = stage(rows.withColumn("reported", F.col("reported") | ((severity("level") <= 2) & fresh)))
        held, came, severe = rows.agg(F.count(F.lit(1)), F.count_if(fresh), F.count_if(fresh & (severity("level") <= 3))).first()
        now, since = time.time(), past["since"] + came
        due = held >= self.min_window and (since >= self.rescore_every or now - past["rescored_at"] >= self.rescore_seconds)
        found, benign, error = None, None, None
        if held and (force or due):
            try:
                found, benign = self._rescore(rows)
            except Exception as e:           # a failed rescore is noted; the stream goes on
                error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
            since, past["rescored_at"] = 0, now
        out = urgent if found is None else urgent.unionByName(found)
        out.write.mode("overwrite").parquet(f"{self.sink}/batch={batch_id}")

        kept = rows.orderBy(F.desc("seq")).limit(self.window)
        if found is not None:
            done = found.select("seq").union(benign.select("seq")).withColumn("_now", F.lit(True))
            kept = kept.join(done, "seq", "left").withColumn("reported", F.col("reported") | F.coalesce("_now", F.lit(False))).drop("_now")
        kept.write.mode("overwrite").parquet(f"{self.state}/window/batch={batch_id}")
        if error is not None:
            spark.createDataFrame([(error,)], "error string").write.mode("overwrite").parquet(f"{self.state}/errors/batch={batch_id}")
        counts = (first + came, past["severe"] + severe, since, past["rescored_at"], past["rescore_errors"] + (error is not None), min(held, self.window))
        (spark.createDataFrame([counts], "entries bigint, severe bigint, since bigint, rescored_at double, rescore_errors bigint, window bigint")
         .write.mode("overwrite").parquet(f"{self.state}/progress/batch={batch_id}"))
        if self.on_anomaly is not None:
            self.ledger.offer(spark.read.parquet(f"{self.sink}/batch={batch_id}"), {"callback": self.on_anomaly}, batch_id, self.tries)
        for part in ("window", "progress"):
            drop_folder(spark, f"{self.state}/{part}/batch={batch_id - 2}")

    def _rescore(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Flagged rows of the window that were not reported: (to report, benign ones to pass over)."""
        low = rows.agg(F.min("seq")).first()[0]
        entries = rows.withColumn("entry_id", F.col("seq") - F.lit(low))
        scored = detect(entries, self.cfg).scored
        hits = scored.filter("flagged").join(rows.filter("reported").select("seq"), "seq", "left_anti")
        mild = is_benign_live("level", "message") if self.suppress_info else F.lit(False)
        hits = stage(hits.withColumn("_mild", mild).select("seq", *ENTRY, "score", "reasons", "_mild"))
        return hits.filter("not _mild").drop("_mild"), hits.filter("_mild")

    def flush(self, spark: SparkSession, batch_id: int) -> None:
        """One forced rescore of what is in the window, for the end of a stream."""
        last = self._previous(spark, batch_id)
        if last is not None:
            self.process(last.select(*ENTRY).limit(0), batch_id, force=True)

    def anomalies(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.sink)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: entries, anomalies, incident, anomalies by level, failed rescores, entries in the window."""
        last = spark.read.parquet(f"{self.state}/progress").orderBy(F.desc("batch")).limit(1)
        levels = self.anomalies(spark).groupBy(F.upper("level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        hits = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("anomalies"),
                          F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("by_level"))
        incident = (F.col("entries") > 0) & (F.col("severe") >= F.lit(self.cfg.volumes.incident) * F.col("entries"))
        return last.join(F.broadcast(hits)).select(                                # one row each
            "entries", "anomalies", incident.alias("incident"), "by_level", "rescore_errors", "window")
