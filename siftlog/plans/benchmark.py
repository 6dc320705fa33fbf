"""Accuracy runs on labelled corpora."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..operators import evaluate as EV, supervised as SU
from .analyze import detect

GRID_WEIGHTS, GRID_THRESHOLDS = [0.3, 0.4, 0.5], [0.5, 0.6, 0.7, 0.8]


def evaluate(labelled: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Confusion counts, precision, recall and F1 of one run; ``labelled`` carries ``label``."""
    return EV.prf1(detect(labelled, cfg).scored, "label", "flagged")


def grid_search(labelled: DataFrame, cfg: Settings = Settings(), weights=None, thresholds=None, min_dfs=(None,)) -> DataFrame:
    """One detection per feature weight (and minimum df); all thresholds in one pass over its scores."""
    weights, thresholds = weights or GRID_WEIGHTS, thresholds or GRID_THRESHOLDS
    out = None
    for w in weights:
        for m in min_dfs:
            scored = detect(labelled, replace(cfg, text=replace(cfg.text, weight=w, min_df=m))).scored
            rows = EV.grid_search(scored.withColumn("feature_weight", F.lit(w)), thresholds).withColumn("min_df", F.lit(m).cast("int"))
            out = rows if out is None else out.unionByName(rows)
    return out


def benchmark_report(labelled: DataFrame, cfg: Settings = Settings(), do_grid: bool = False, do_supervised: bool = False,
                     min_f1: float | None = None, trees: int = 300) -> DataFrame:
    """One row per part: ``baseline``, optionally ``grid_best`` and ``supervised``.

    With ``min_f1`` a lower baseline F1 raises.
    """
    run = detect(labelled, cfg)
    cols = ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    base = EV.prf1(run.scored, "label", "flagged")
    out = base.select(F.lit("baseline").alias("part"), *cols)
    if do_grid:
        out = out.unionByName(EV.best_grid_point(grid_search(labelled, cfg)).select(F.lit("grid_best").alias("part"), *cols))
    if do_supervised:
        matrix = SU.feature_matrix(run.scored)
        out = out.unionByName(SU.train_and_evaluate(matrix, "entry_id", trees=trees).select(F.lit("supervised").alias("part"), *cols))
    if min_f1 is not None:
        f1 = base.first()["f1"]
        if f1 < min_f1:
            raise ValueError(f"F1 {f1:.3f} is below the required {min_f1:.3f}")
    return out


def throughput(entries: DataFrame, modes: dict) -> list[dict]:
    """Seconds, lines/s and flagged entries of each mode; a mode maps entries to a scored DataFrame."""
    rows = []
    n = entries.count()
    for name, run in modes.items():
        t = time.perf_counter()
        flagged = run(entries).filter("flagged").count()
        dt = time.perf_counter() - t
        rows.append({"mode": name, "lines": n, "seconds": dt, "lines_per_s": n / dt if dt else 0.0, "anomalies": flagged})
    return rows
