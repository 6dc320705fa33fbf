"""Rate bursts: severe entries in windows far above their own median rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.times import window_index
from ..runtime import lookup_join


# fixed values: the defaults decide results
@dataclass(frozen=True)
class Bursts:
    """A window of ``width`` seconds is hot from ``least`` severe entries and ``factor`` times the median rate on."""

    width: float = 60.0
    factor: float = 4.0
    least: int = 10
    on: bool = True


def with_window(prepared: DataFrame, bursts: Bursts = Bursts()) -> DataFrame:
    """Window number counted from the earliest stamp of the corpus (a scalar subquery)."""
    start = prepared.select(F.min("epoch").alias("t0")).scalar()
    return prepared.withColumn("win", window_index(F.col("epoch"), start, bursts.width))


def window_counts(windowed: DataFrame) -> DataFrame:
    return (windowed.filter(F.col("epoch").isNotNull() & (F.col("sev") <= 4))
            .groupBy("sev", "win").agg(F.count(F.lit(1)).alias("cnt")))


def hot_windows(windowed: DataFrame, bursts: Bursts = Bursts()) -> DataFrame:
    """(severity, window) pairs whose count reaches max(min, factor · max(median, 1))."""
    counts = window_counts(windowed)
    per_sev = counts.groupBy("sev").agg(F.median("cnt").alias("base"), F.sum("cnt").alias("timed"),
                                        F.count(F.lit(1)).alias("wins"))
    timed_rows = windowed.select(F.count("epoch").alias("n")).scalar()
    cut = F.greatest(F.lit(float(bursts.least)), F.lit(bursts.factor) * F.greatest(F.col("base"), F.lit(1.0)))
    usable = (per_sev.filter((F.col("timed") >= bursts.least) & (F.col("wins") >= 2)
                             & (timed_rows >= max(bursts.least * 2, 20)))
              .select("sev", "base", cut.alias("cut")))
    return (counts.join(F.broadcast(usable), "sev")        # at most five severities
            .filter(F.col("cnt") >= F.col("cut")).select("sev", "win", "cnt", "base", "cut"))


def mark_bursts(prepared: DataFrame, bursts: Bursts = Bursts(), hot: DataFrame | None = None) -> DataFrame:
    """Add ``burst``: the entry's severity is hot in the entry's window."""
    if not bursts.on:
        return prepared.withColumn("burst", F.lit(False))
    windowed = with_window(prepared, bursts)
    hot = hot_windows(windowed, bursts) if hot is None else hot
    marked = lookup_join(windowed, hot.select("sev", "win", F.lit(True).alias("_hot")), ["sev", "win"], "left")
    return marked.withColumn("burst", F.coalesce("_hot", F.lit(False))).drop("_hot", "win")
