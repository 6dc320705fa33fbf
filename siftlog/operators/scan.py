"""Template scan: one aggregate over the lines, a score per template."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.levels import scan_weight
from ..functions.text import scan_mask

SCAN_CUT = 0.5


def template_scan(entries: DataFrame) -> DataFrame:
    """``level, template, cnt, sample, service, score`` per masked message.

    Rarity is ln(1+N/c) / ln(1+N).  When more than half of the entries are
    unique templates, severity counts more than rarity.  The line pass is a
    single partial/final hash aggregate; totals are scalar subqueries.
    """
    first = F.min_by(F.struct("message", "service"), "entry_id")
    counts = (entries.withColumn("template", scan_mask("message")).groupBy("level", "template")
              .agg(F.count(F.lit(1)).alias("cnt"), first.alias("_first")))
    total = counts.select(F.sum("cnt").alias("t")).scalar()
    unique = counts.select(F.count(F.lit(1)).alias("u")).scalar()
    weight = scan_weight("level")
    rarity = F.log1p(total / F.col("cnt")) / F.log1p(total)
    score = F.when(unique > F.lit(0.5) * total, F.lit(0.75) * weight + F.lit(0.25) * rarity).otherwise(
        F.lit(0.55) * rarity + F.lit(0.45) * weight)
    return counts.select("level", "template", "cnt", F.col("_first.message").alias("sample"), F.col("_first.service").alias("service"),
                         F.round(F.least(score, F.lit(1.0)), 4).alias("score"))


def scan_anomalies(scan: DataFrame, cut: float = SCAN_CUT) -> DataFrame:
    return scan.filter(F.col("score") >= cut)


def scan_summary(scan: DataFrame, top: int = 20) -> DataFrame:
    """One row: lines, unique templates, redundancy, anomaly count and the top templates."""
    best = scan_anomalies(scan).orderBy(F.desc("score"), "level", "template").limit(top)
    best = best.withColumn("_rank", F.struct(-F.col("score"), "level", "template"))
    top_rows = best.select(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "_rank", F.concat(F.col("level"), F.lit(" x"), F.col("cnt").cast("string"), F.lit(" "),
                          F.left("sample", F.lit(200))).alias("line")))), lambda r: r.getField("line")), "\n").alias("t")).scalar()
    return scan.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("parsed_lines"), F.count(F.lit(1)).alias("unique_templates"),
                    F.count_if(F.col("score") >= SCAN_CUT).alias("anomaly_count")).select(
        "parsed_lines", "unique_templates",
        F.when(F.col("parsed_lines") > 0, F.round(1 - F.col("unique_templates") / F.col("parsed_lines"), 4)).otherwise(0.0).alias("redundancy"),
        "anomaly_count", top_rows.alias("top_anomalies"))
