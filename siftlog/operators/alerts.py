"""Alert gate: cooldown per key, hourly cap per application, statistics."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.levels import record_level, severity
from ..functions.text import alert_key
from ..runtime import lookup_join, stage

COOLDOWN, MAX_PER_HOUR, HOUR = 300.0, 30, 3600.0
FORGET_KEYS = 1_000           # keys held before those that no longer cool down are dropped


def alert_min_level(anomalies: DataFrame, level: str) -> DataFrame:
    """Anomalies at least as severe as ``level``."""
    return anomalies.filter(severity("level") <= severity(F.lit(level)))


def with_alert_key(anomalies: DataFrame) -> DataFrame:
    return anomalies.withColumn("key", alert_key("level", "service", "message"))


def app_records(records: DataFrame) -> DataFrame:
    """Structured application records → entries: level names mapped, logger as service."""
    return records.select(
        "entry_id", F.col("ts_raw"), record_level("level_name").alias("level"),
        F.coalesce(F.nullif("logger", F.lit("")), F.lit("unknown")).alias("service"), "message",
        F.create_map(F.lit("logger"), F.col("logger"), F.lit("pid"), F.col("pid").cast("string")).alias("metadata"))


class Gate:
    """The running state of one application: stamps of the last hour, last alert per key."""

    def __init__(self, cooldown: float, max_per_hour: int | None,
                 stamps: list[float] | None = None, last: dict[str, float] | None = None):
        self.cooldown, self.cap = cooldown, max_per_hour
        self.stamps, self.last = deque(stamps or []), dict(last or {})

    def allow(self, key: str, now: float) -> bool:
        if self.cap is not None:
            while self.stamps and now - self.stamps[0] >= HOUR:
                self.stamps.popleft()
            if len(self.stamps) >= self.cap:
                return False
        before = self.last.get(key)
        if before is not None and now - before < self.cooldown:
            return False
        self.last[key] = now
        if self.cap is not None:
            self.stamps.append(now)
        return True

    def forget(self, now: float) -> None:
        """Drop keys whose cooldown is over; they no longer decide anything."""
        self.last = {k: t for k, t in self.last.items() if now - t < self.cooldown}


def _spans(first: DataFrame, owner: list[str], silence: float) -> DataFrame:
    """Rows with ``_span``: a new span of an owner begins after a silence of at least ``silence`` seconds.

    Neighbouring alerts that far apart never share a bucket of that width, so
    buckets are aggregated first and only their ends are compared: one row per
    owner and bucket, however many alerts it holds.
    """
    rows = first.withColumn("_bucket", F.floor(F.col("ts") / F.lit(silence)))
    ends = rows.groupBy(*owner, "_bucket").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    order = W.partitionBy(*owner).orderBy("_bucket")
    begins = F.coalesce(F.col("_lo") - F.lag("_hi").over(order) >= F.lit(silence), F.lit(True))
    spans = (ends.withColumn("_begins", begins.cast("int")).withColumn("_span", F.sum("_begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
             .select(*[F.col(c).alias(f"_{c}") for c in owner], F.col("_bucket").alias("_at"), "_span"))
    same = F.col("_bucket") == F.col("_at")
    for c in owner:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(spans, same).select(*first.columns, "_span")


def alert_gate(alerts: DataFrame, cooldown: float = COOLDOWN, max_per_hour: int | None = MAX_PER_HOUR) -> DataFrame:
    """``app, key, ts, alert_id`` of the alerts that pass, in time order per application.

    ``alerts`` has ``app, key, ts, alert_id``; rows without ``ts`` never pass,
    null applications and keys are values like others.  Alerts of one key at
    one moment are reduced to the first before anything is ordered: the others
    are suppressed whatever happens.

    With a cap all keys of an application share one state; without, each key
    has its own.  The state is empty after a silence as long as it reaches
    back (an hour or the cooldown), so the time line is cut there and the spans
    are spread over the cluster.  A task walks its sorted spans batch by batch
    and holds only the state, at most the cap's stamps and the keys that cool
    down.  A span without any silence is one sorted walk by its nature.
    """
    columns = ["app", "key", "ts", "alert_id"]
    first = (alerts.filter(F.col("ts").isNotNull() & ~F.isnan(F.col("ts").cast("double")))
             .groupBy("app", "key", F.col("ts").cast("double").alias("ts")).agg(F.min("alert_id").alias("alert_id")))
    owner = ["app"] if max_per_hour is not None else ["app", "key"]
    silence = float(cooldown) if max_per_hour is None else max(HOUR, float(cooldown))
    if silence <= 0:
        return first.select(*columns)          # nothing ever cools down

    def walk(batches):
        at, gate = None, None
        for pdf in batches:
            ok = []
            for app, key, ts, span in zip(pdf["app"], pdf["key"], pdf["ts"], pdf["_span"]):
                place = (app, key if max_per_hour is None else None, span)
                if gate is None or place != at:
                    at, gate = place, Gate(cooldown, max_per_hour)
                ok.append(gate.allow(key, ts))
                if len(gate.last) > FORGET_KEYS and ok[-1]:
                    gate.forget(ts)
            yield pdf.loc[ok, columns]

    placed = stage(_spans(first, owner, silence))
    return (placed.repartition(*owner, "_span").sortWithinPartitions(*owner, "_span", "ts", "alert_id")
            .mapInPandas(walk, "app string, key string, ts double, alert_id bigint"))


def delivery_stats(alerts: DataFrame, passed: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``app, offered, sent, suppressed, errors`` with the outcomes of a ledger (``alert_id, sent, errors``).

    Sent is what some channel took; suppressed what the gate held back; errors
    are failed offers.  An alert that passed and that no channel took is neither.
    """
    known = lookup_join(passed.select("app", "alert_id"), stage(deliveries.select("alert_id", "sent", "errors")), ["alert_id"], "left")
    done = known.groupBy("app").agg(F.count_if("sent").alias("_sent"), F.coalesce(F.sum("errors"), F.lit(0)).alias("_errors")).withColumnRenamed("app", "_app")
    gate = alert_stats(alerts, passed).drop("sent")
    return (gate.join(done, F.col("app").eqNullSafe(F.col("_app")), "left")
            .select("app", "offered", F.coalesce("_sent", F.lit(0)).alias("sent"), "suppressed", F.coalesce("_errors", F.lit(0)).alias("errors")))


def alert_stats(alerts: DataFrame, passed: DataFrame) -> DataFrame:
    """``app, offered, sent, suppressed`` by the gate alone; see ``delivery_stats`` for what the channels made of them."""
    offered = alerts.groupBy("app").agg(F.count(F.lit(1)).alias("offered"))
    sent = passed.groupBy("app").agg(F.count(F.lit(1)).alias("sent"))
    return (offered.join(sent, "app", "left").na.fill({"sent": 0})
            .withColumn("suppressed", F.col("offered") - F.col("sent")))
