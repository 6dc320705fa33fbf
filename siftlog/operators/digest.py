"""Digest and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clip, fixed_point

MAX_LINES, MAX_CONTEXT = 40, 20


def group_summaries(families: DataFrame, cap: int = 40) -> DataFrame:
    """One text line per family, best first."""
    order = [F.desc("max_score"), F.desc("cnt"), F.asc("first_rank")]
    why = F.when(F.size("reasons") > 0, F.concat(F.lit(" | signals: "), F.array_join("reasons", "; "))).otherwise("")
    line = F.concat(F.lit("["), F.col("lvl"), F.lit("] "), F.col("service"), F.lit(" (x"), F.col("cnt").cast("string"),
                    F.lit(", score "), fixed_point("max_score", 2), F.lit("): "), F.left("sample", F.lit(160)), why)
    return families.orderBy(*order).limit(cap).select("lvl", "service", "family", line.alias("line"))


def family_messages(families: DataFrame) -> DataFrame:
    """Representative text of each family for the digest."""
    text = F.concat(F.col("sample"), F.lit(" (occurred ×"), F.format_number("cnt", 0),
                    F.lit(", score "), fixed_point("max_score", 2), F.lit(")"))
    return families.select(F.col("lvl").alias("level"), "service", text.alias("message"), F.col("max_score").alias("score"),
                           F.array_join("reasons", "; ").alias("reason"), "first_rank", "cnt")


def rca_digest(ranked: DataFrame, context: DataFrame | None = None, source_name: str = "") -> DataFrame:
    """One text of the best 40 lines (and up to 20 context lines) for a reader or a text model.

    ``ranked``: level, service, message, score, reason, rank_id.
    ``context``: line, rank_id.  Only the capped lines are gathered.
    """
    total = ranked.select(F.count(F.lit(1)).alias("n")).scalar()
    line = F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("service"), F.lit(": "), clip("message"),
                    F.lit(" score="), fixed_point("score", 2),
                    F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" reason="), F.col("reason"))).otherwise(""))
    top = ranked.orderBy("rank_id").limit(MAX_LINES).select("rank_id", line.alias("l"))
    head = F.concat(F.lit("Total anomalies detected locally: "), total.cast("string"),
                    F.lit("\n\n--- ANOMALOUS LINES (top, by score) ---\n"))
    if source_name:
        head = F.concat(F.lit(f"Log source: {source_name}\n"), head)

    def joined(rows: DataFrame) -> Column:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("rank_id", "l"))), lambda r: r.getField("l"))
        return F.array_join(lines, "\n")

    out = top.agg(F.count(F.lit(1)).alias("lines_sent"), joined(top).alias("_body"))
    tail = F.lit("")
    if context is not None:
        few = context.orderBy("rank_id").limit(MAX_CONTEXT).select("rank_id", clip("line").alias("l"))
        text = few.agg(joined(few).alias("t")).scalar()
        tail = F.when(F.coalesce(text, F.lit("")) != "",
                      F.concat(F.lit("\n\n--- SURROUNDING NORMAL CONTEXT (sample) ---\n"), text)).otherwise("")
    return out.select("lines_sent", F.concat(head, F.col("_body"), tail).alias("digest"))


def run_meta(scored: DataFrame, stats: DataFrame, threshold: float, cfg_threshold: float, eps: float | None) -> DataFrame:
    """One row of run facts: template counts, severe share, thresholds, chronic and rare templates."""
    t = stats.agg(F.count(F.lit(1)).alias("unique_templates"), F.count_if(F.col("chronic")).alias("chronic_templates"),
                  F.count_if(F.col("global_rare")).alias("global_rare_templates"))
    severe = scored.select(F.avg((F.col("sev") <= 3).cast("double")).alias("s")).scalar()
    return t.select("unique_templates", severe.alias("severe_share"), F.lit(cfg_threshold).alias("flag_threshold"),
                    F.lit(threshold).alias("threshold_used"), "chronic_templates", "global_rare_templates",
                    F.lit(eps).cast("double").alias("eps"))
