"""Entries → templates: keys, counts, spans, representatives, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.levels import severity
from ..functions.text import template_key
from ..functions.times import parse_timestamp
from ..runtime import lookup_join

KEY = ["lvl", "template"]
YEAR = 2024                   # of time stamps that carry none


def prepare(entries: DataFrame, year: int = YEAR) -> DataFrame:
    """Add the derived columns that every later step reads: ``lvl, sev, template, epoch``."""
    return (entries.withColumn("lvl", F.upper("level"))
            .withColumn("sev", severity("level"))
            .withColumn("template", template_key("message"))
            .withColumn("epoch", parse_timestamp("ts_raw", year)))


def template_counts(prepared: DataFrame) -> DataFrame:
    """One row per (level, template) with its count and first and last position."""
    return (prepared.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("entry_id").alias("first_id"),
        F.max("entry_id").alias("last_id")))


def build_templates(prepared: DataFrame, head_cut: int | None = None) -> DataFrame:
    """Templates with representative (first entry), span ends and head count.

    ``template_id`` is the position of the first entry, which is unique and
    stable.  One hash aggregate; positions are never collected.
    """
    head = F.count_if(F.col("entry_id") < F.lit(head_cut)) if head_cut is not None else F.lit(None).cast("bigint")
    burst = F.max("burst") if "burst" in prepared.columns else F.lit(False)
    return (prepared.groupBy(*KEY).agg(
        F.min("entry_id").alias("template_id"),
        F.first("sev").alias("sev"),
        F.count(F.lit(1)).alias("cnt"),
        F.min("entry_id").alias("first_id"),
        F.max("entry_id").alias("last_id"),
        head.alias("head_cnt"),
        burst.alias("any_burst"),
        F.min_by(F.struct("level", "service", "message"), "entry_id").alias("rep")))


def template_representatives(prepared: DataFrame) -> DataFrame:
    return (prepared.groupBy(*KEY).agg(F.min("entry_id").alias("template_id"),
                                       F.min_by(F.struct("service", "message"), "entry_id").alias("rep"))
            .select("template_id", *KEY, "rep.service", F.col("rep.message").alias("rep_message")))


def first_services(rows: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """The first ``limit`` service names, in order, per key.

    Names are made distinct before the ranking, and the rank limit is applied
    map-side, so a key with very many services stays small.
    """
    names = rows.groupBy(*keys, "service").agg(F.lit(1).alias("_one"))
    ranked = names.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("service")))
    return (ranked.filter(F.col("_r") <= limit).groupBy(*keys)
            .agg(F.array_sort(F.collect_list("service")).alias("services")))


def with_template_id(prepared: DataFrame, templates: DataFrame) -> DataFrame:
    return lookup_join(prepared, templates.select(*KEY, "template_id"), KEY)


def redundancy(prepared: DataFrame) -> DataFrame:
    """Distinct templates and 1 − unique / entries, from one two-level aggregate."""
    counts = prepared.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.agg(F.sum("cnt").alias("entries"), F.count(F.lit(1)).alias("unique_templates")).select(
        "entries", "unique_templates",
        F.when(F.col("entries") > 0, 1 - F.col("unique_templates") / F.col("entries")).otherwise(0.0).alias("redundancy"))


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.upper("level").alias("level")).agg(F.count(F.lit(1)).alias("cnt"))
