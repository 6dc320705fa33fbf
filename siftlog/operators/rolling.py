"""Count-based sliding frames without a whole-source window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import BLOCK_ROWS, block_of


def rolling_counts(entries: DataFrame, measures: dict[str, Column], window: int = 500, block_rows: int = BLOCK_ROWS,
                   key: str = "source", pos: str = "pos", totals: dict[str, Column] | None = None) -> DataFrame:
    """Running aggregates over the last ``window`` rows of each source.

    Each block of consecutive positions is joined by the ``window`` − 1 rows
    before it, from as many earlier blocks as that takes, so a source of any size
    is spread over its blocks.  ``measures`` are any aggregates, worked out frame by frame: rows times
    ``window`` steps.  ``totals`` are whole numbers per row (null: 0) that are summed: a frame is the running total
    less the one before the frame, one step a row.
    """
    own = block_of(pos, block_rows)
    copies = F.sequence(own, block_of(F.col(pos) + F.lit(max(window, 1) - 1), block_rows))
    spread = entries.withColumn("_own", own).withColumn("_block", F.explode(copies))
    frame = W.partitionBy(key, "_block").orderBy(pos).rowsBetween(-(window - 1), 0)
    for name, agg in measures.items():
        spread = spread.withColumn(name, agg.over(frame))
    order = W.partitionBy(key, "_block").orderBy(pos)
    running = {n: F.sum(F.coalesce(c.cast("bigint"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)) for n, c in (totals or {}).items()}
    spread = spread.withColumns(running) if running else spread
    for name in running:
        spread = spread.withColumn(name, F.col(name) - F.coalesce(F.lag(name, window).over(order), F.lit(0)))
    return spread.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")
