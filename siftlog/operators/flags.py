"""Per-template flags: flood, span, history, recurring, chronic, globally rare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X
from ..functions.text import fixed_point


# fixed values: the defaults decide results
@dataclass(frozen=True)
class Volumes:
    """Shares of all entries: of a flooding template, of a recurring one (or ``recurring_least`` entries), of severe ones in an incident."""

    flood: float = 0.20
    recurring: float = 0.002
    recurring_least: int = 5
    incident: float = 0.30


def head_cut(n: int) -> int:
    return int(n * X.HISTORY_HEAD)


def add_flags(templates: DataFrame, n: int, volumes: Volumes = Volumes(),
              has_baseline: bool = False) -> DataFrame:
    """Row-local rules over template counts; ``n`` is the number of entries."""
    share = F.col("cnt") / F.lit(n)
    severe = F.col("sev") <= 4
    span = F.when(F.col("cnt") > 1, (F.col("last_id") - F.col("first_id")) / F.lit(float(max(n - 1, 1)))).otherwise(0.0)
    out = (templates.withColumn("share", share)
           .withColumn("span", span)
           .withColumn("head_share", F.col("head_cnt") / F.col("cnt"))
           .withColumn("flood", severe & (share >= volumes.flood))
           .withColumn("global_rare", share <= X.GLOBAL_RARE_SHARE))
    if not has_baseline:
        out = out.withColumn("novel", F.lit(False)).withColumn("surge", F.lit(False))
        known_noise: Column = F.lit(False)
    else:
        known_noise = ~F.col("novel") & ~F.col("surge")
    recurring_cut = max(volumes.recurring_least, int(n * volumes.recurring))
    chronic = (F.col("sev").isin(3, 4)
               & ((share >= X.CHRONIC_SHARE) | (F.col("cnt") >= X.CHRONIC_MIN_COUNT))
               & (F.col("span") >= X.CHRONIC_SPREAD) & ~F.coalesce("any_burst", F.lit(False)))
    return (out.withColumn("recurring", severe & (F.col("cnt") >= recurring_cut) & ~known_noise)
            .withColumn("chronic", chronic))


def incident(entries: DataFrame, volumes: Volumes = Volumes()) -> DataFrame:
    """One row: severe entries, their share, incident mode and the note."""
    total = F.count(F.lit(1))
    severe = F.count_if(F.col("sev") <= 3)
    row = entries.agg(total.alias("entries"), severe.alias("severe_entries"))
    share = F.when(F.col("entries") > 0, F.col("severe_entries") / F.col("entries")).otherwise(0.0)
    row = row.withColumn("severe_share", share).withColumn("incident_mode", F.col("severe_share") >= volumes.incident)
    note = F.when(F.col("incident_mode"), F.concat(
        fixed_point(F.col("severe_share") * 100, 0),
        F.lit("% of entries are ERROR or worse — corpus looks like an incident window"))).otherwise("")
    return row.withColumn("incident_note", note)


def report_incident(flagged: DataFrame, total: Column) -> DataFrame:
    """Report variant: flagged entries at four severe levels as a share of all entries."""
    severe = F.count_if(F.upper("level").isin("EMERGENCY", "FATAL", "CRITICAL", "ERROR"))
    row = flagged.agg(F.count(F.lit(1)).alias("anomalies"), severe.alias("severe_anomalies"))
    return (row.withColumn("entries", total)
            .withColumn("severe_share", F.when(total > 0, F.col("severe_anomalies") / total).otherwise(0.0))
            .withColumn("incident", (F.col("anomalies") > 0) & (F.col("severe_share") >= 0.30)))
