"""Log lines from files, tables, DataFrames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..runtime import stage

LINE_SCHEMA = "value string"


def scan_text(spark: SparkSession, path: str, source_depth: int = 1) -> DataFrame:
    """``source, value`` plus the block position of each line; bad bytes are replaced by the reader."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"), "value")


def number_lines(scanned: DataFrame) -> DataFrame:
    """``source, line_no, value`` with the 0-based line number inside each file.

    The scan is staged once as columns; each file block then contributes one
    small row (its size), and running totals over those give every line its
    number.  No line is sorted or moved.
    """
    rows = stage(scanned.withColumn("mid", F.monotonically_increasing_id()))
    blocks = rows.groupBy("source", "block_start").agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("source", "block_start", "first_mid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(starts, ["source", "block_start"]).select(
        "source", (F.col("offset") + F.col("mid") - F.col("first_mid")).alias("line_no"), "value")


def from_lines(spark: SparkSession, lines: list[str], source: str = "lines") -> DataFrame:
    """A handful of in-memory lines, for interactive use and tests."""
    return spark.createDataFrame([(source, i, v) for i, v in enumerate(lines)], "source string, line_no bigint, value string")


def read_logs(spark: SparkSession, path: str | None = None, lines: list[str] | None = None,
              table: str | None = None, df: DataFrame | None = None) -> DataFrame:
    """Numbered lines from exactly one of a path, in-memory lines, a table or a DataFrame.

    A table or DataFrame brings its own ``source, line_no, value``.
    """
    given = [n for n, v in (("path", path), ("lines", lines), ("table", table), ("df", df)) if v is not None]
    if len(given) != 1:
        raise ValueError(f"read_logs takes exactly one of path, lines, table, df (got {', '.join(given) or 'none'})")
    if path is not None:
        return number_lines(scan_text(spark, path))
    if lines is not None:
        return from_lines(spark, lines)
    out = spark.table(table) if table is not None else df
    missing = {"source", "line_no", "value"} - set(out.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return out


def limit_lines(numbered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each source, by number."""
    return numbered.filter(F.col("line_no") < n)


def stream_text(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """An unbounded scan of a directory of text files."""
    return (spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
            .select(F.col("_metadata.file_path").alias("source"), "value"))
