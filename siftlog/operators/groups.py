"""Groups, patterns, families and ordered views of flagged entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import keep_in_report, severity, sort_severity
from ..functions.text import family_key
from ..runtime import lookup_join, number_ordered
from .templates import KEY, first_services

PATTERN_LEAST, PATTERN_TOP = 5, 15        # fixed values


def _merged_reasons(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Ordered union of the reason lists of each key.

    ``parts`` has one row per (key, distinct reason list); a template has only
    a handful of them, however many entries it has.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first_flagged", column)))
    return parts.groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.transform(ordered, lambda r: r.getField(column)))).alias(column))


def anomaly_groups(scored: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Flagged entries per template: count, best score, first message, reasons, services.

    Ordered by score, severity and count; ties by level and template.
    """
    hits = scored.filter("flagged")
    parts = hits.groupBy(*KEY, reasons).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("score").alias("score"), F.min("entry_id").alias("first_flagged"),
        F.min_by("message", "entry_id").alias("message"))
    totals = parts.groupBy(*KEY).agg(
        F.sum("cnt").alias("cnt"), F.max("score").alias("score"), F.min("first_flagged").alias("first_id"),
        F.min_by("message", "first_flagged").alias("rep_message"))
    merged = _merged_reasons(parts, KEY, reasons)
    return (totals.join(merged, KEY).join(first_services(hits, KEY), KEY)
            .orderBy(F.desc("score"), severity("lvl"), F.desc("cnt"), "lvl", "template"))


def patterns(scored: DataFrame, n: int, least: int = PATTERN_LEAST, top: int = PATTERN_TOP) -> DataFrame:
    """Recurring severe templates, flagged or not: the ``top`` first ones of at least ``least`` entries, by severity and count."""
    severe = scored.filter(F.col("sev") <= 4)
    totals = (severe.groupBy(*KEY).agg(
        F.first("sev").alias("sev"), F.count(F.lit(1)).alias("cnt"), F.max("flagged").alias("flagged"),
        F.min_by("message", "entry_id").alias("rep_message"))
        .filter(F.col("cnt") >= least).withColumn("share", F.col("cnt") / F.lit(n)))
    first = totals.orderBy("sev", F.desc("cnt"), "lvl", "template").limit(top)
    few = severe.join(F.broadcast(first.select(*KEY)), KEY, "left_semi")      # at most ``top`` keys
    return first.join(first_services(few, KEY), KEY).orderBy("sev", F.desc("cnt"), "lvl", "template")


def incident_families(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged entries per (level, service, family mask), best first.

    The sample and the reasons are those of the first entry; the reasons are
    those of the first entry that has any.
    """
    keyed = flagged.withColumn("lvl", F.upper("level")).withColumn("family", family_key("message"))
    fam = keyed.groupBy("lvl", "service", "family").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("score").alias("max_score"), F.min("rank_id").alias("first_rank"),
        F.min_by("message", "rank_id").alias("sample"),
        F.min_by("reasons", F.when(F.size("reasons") > 0, F.col("rank_id"))).alias("reasons"))
    fam = fam.withColumn("max_score", F.greatest("max_score", F.lit(0.0)))
    fam = fam.orderBy(F.desc("max_score"), F.desc("cnt"), "first_rank")
    return fam if limit is None else fam.limit(limit)


def rank_anomalies(scored: DataFrame) -> DataFrame:
    """Flagged entries with their position by (score desc, entry_id)."""
    hits = scored.filter("flagged")
    return number_ordered(hits, [F.desc("score"), F.asc("entry_id")], "rank_id")


def report_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(keep_in_report("level", "message"))


def sorted_anomalies(flagged: DataFrame, by: str = "severity") -> DataFrame:
    """``severity`` (worst first), ``service`` or ``time`` (entry order); ties keep the rank order."""
    orders: dict[str, list[Column]] = {
        "severity": [sort_severity("level").desc(), F.col("rank_id")],
        "service": [F.col("service"), F.col("rank_id")],
        "time": [F.col("rank_id")],
    }
    if by not in orders:
        raise ValueError(f"unknown order {by!r}; use one of {sorted(orders)}")
    return flagged.orderBy(*orders[by])


def explain_top(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "entry_id").limit(n)


def run_summary(scored: DataFrame, groups: DataFrame, pats: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: entries, clusters, anomalies, noise points, groups and patterns."""
    clusters = (templates.filter(F.col("cluster") != -1).select(F.countDistinct("cluster").alias("c")).scalar())
    return scored.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("flagged")).alias("anomalies"),
                      F.count_if(F.col("cluster") == -1).alias("noise_points")).select(
        "entries", clusters.alias("clusters"), "anomalies", "noise_points",
        groups.select(F.count(F.lit(1)).alias("c")).scalar().alias("anomaly_groups"),
        pats.select(F.count(F.lit(1)).alias("c")).scalar().alias("patterns"))


def cluster_sizes(templates: DataFrame) -> DataFrame:
    return templates.groupBy("cluster").agg(F.sum("cnt").alias("entries"), F.count(F.lit(1)).alias("templates"))


def with_entry_cluster(prepared: DataFrame, templates: DataFrame) -> DataFrame:
    return lookup_join(prepared, templates.select(*KEY, "template_id", "cluster"), KEY)
