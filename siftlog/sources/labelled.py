"""Labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.base import is_blank
from ..operators.parse import detect_format, parse_lines


def split_labels(lines: DataFrame, form: str = "bgl") -> DataFrame:
    """``label`` and ``line`` from ``value``.

    bgl: first token, ``-`` is normal.  labeled: integer, tab, line.
    jsonl: an object with ``label`` and ``line``.
    """
    lines = lines.filter(~is_blank("value"))
    v = F.col("value")
    if form == "bgl":
        cut = F.instr(v, " ")
        label = F.when(F.when(cut > 0, F.left(v, cut - 1)).otherwise(v) == "-", 0).otherwise(1)
        text = F.when(cut > 0, F.substr(v, cut + 1)).otherwise("")
    elif form == "labeled":
        cut = F.instr(v, "\t")
        label = F.trim(F.when(cut > 0, F.left(v, cut - 1)).otherwise(v)).cast("int")
        text = F.when(cut > 0, F.substr(v, cut + 1)).otherwise("")
    elif form == "jsonl":
        label = F.coalesce(F.get_json_object(v, "$.label").cast("int"), F.lit(0))
        text = F.coalesce(F.get_json_object(v, "$.line"), F.lit(""))
    else:
        raise ValueError(f"unknown label format: {form}")
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(*keep, label.alias("label"), text.alias("line"))


def first_token_labels(lines: DataFrame) -> DataFrame:
    """Label of whole lines by their first token; blank lines are normal."""
    token = F.substring_index("value", " ", 1)
    return lines.withColumn("label", F.when(is_blank("value") | (token == "-"), 0).otherwise(1))


def jsonl_entries(lines: DataFrame) -> DataFrame:
    """Entries with label from JSON lines, with defaults for missing fields."""
    schema = "timestamp string, level string, service string, message string, label int"
    o = lines.filter(~is_blank("value")).withColumn("o", F.from_json("value", schema))
    keep = [c for c in lines.columns if c != "value"]
    return o.select(*keep, F.coalesce("o.timestamp", F.lit("")).alias("ts_raw"), F.coalesce("o.level", F.lit("INFO")).alias("level"),
                    F.coalesce("o.service", F.lit("unknown")).alias("service"), F.coalesce("o.message", F.lit("")).alias("message"),
                    F.coalesce("o.label", F.lit(0)).alias("label"), F.col("value").alias("raw"))


def join_sidecar(entries: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Labels kept beside the log, joined by position."""
    return entries.join(labels, on, "inner")


def load_labelled(lines: DataFrame, form: str = "bgl") -> DataFrame:
    """Entries with labels; every line of a source has the format of the source's first line."""
    rows = split_labels(lines, form)
    first = (rows.groupBy("source").agg(F.min_by("line", "line_no").alias("_l"))
             .select("source", detect_format("_l").alias("format")))
    rows = rows.join(F.broadcast(first), "source") if _few(first) else rows.join(first, "source")
    blank = is_blank("line")
    parsed = parse_lines(rows.select("source", "line_no", "label", F.col("line").alias("value"), "format"))
    empty = rows.filter(blank).select(
        "source", "line_no", "label", "format", F.lit("").alias("ts_raw"), F.lit("INFO").alias("level"),
        F.lit("unknown").alias("service"), F.col("line").alias("message"), F.col("line").alias("raw"),
        F.lit(False).alias("parsed"), F.create_map().cast("map<string,string>").alias("metadata"))
    return parsed.unionByName(empty)


def _few(df: DataFrame) -> bool:
    from ..runtime import fits

    return fits(df)
