"""Comparison with an earlier period: novel and surging templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import lookup_join, stage

SURGE_LEAST = 3               # fixed value: entries of a template that can surge


def baseline_key(level: Column, template: Column) -> Column:
    return F.concat(level, F.lit("|"), template)


def build_baseline(prepared: DataFrame) -> DataFrame:
    """``template_key, base_count`` of a period; its total is the sum of the counts."""
    return (prepared.groupBy(baseline_key(F.col("lvl"), F.col("template")).alias("template_key"))
            .agg(F.count(F.lit(1)).alias("base_count")))


def compare(templates: DataFrame, baseline: DataFrame, n: Column, least: int = SURGE_LEAST) -> DataFrame:
    """Add ``base_count, novel, surge`` to templates (left join on the key); nothing is novel to an empty baseline."""
    baseline = stage(baseline)
    total_rows = baseline.agg(F.coalesce(F.sum("base_count"), F.lit(0))).first()[0]
    total = F.lit(total_rows)
    keyed = templates.withColumn("template_key", baseline_key(F.col("lvl"), F.col("template")))
    joined = (lookup_join(keyed, baseline, ["template_key"], "left")
              .withColumn("base_count", F.coalesce("base_count", F.lit(0).cast("bigint"))))
    known = F.col("base_count") > 0
    surge = (known & (total > 0) & (F.col("cnt") / n > 10 * (F.col("base_count") / total))
             & (F.col("cnt") >= least))
    return joined.withColumn("novel", F.lit(bool(total_rows)) & ~known).withColumn("surge", F.coalesce(surge, F.lit(False))).drop("template_key")


def novel_templates(templates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Templates unknown to the baseline; none if the baseline is empty."""
    baseline = stage(baseline)
    keyed = templates.withColumn("template_key", baseline_key(F.col("lvl"), F.col("template")))
    if not baseline.agg(F.coalesce(F.sum("base_count"), F.lit(0))).first()[0]:
        return keyed.drop("template_key").filter(F.lit(False))
    return lookup_join(keyed, baseline.select("template_key"), ["template_key"], "left_anti").drop("template_key")
