"""Levels, severities and the words that give them away."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X
from .base import col, contains_any, extract, literal_array, lookup, matches


def infer_level(text) -> Column:
    word = F.lower(extract(text, X.LEVEL_WORD_PATTERN, 1, ignore_case=True))
    return lookup(word, X.LEVEL_WORD, "INFO")


def norm_level(token) -> Column:
    token = col(token)
    return lookup(F.lower(token), X.LEVEL_WORD, F.upper(token))


def syslog_level(line) -> Column:
    """Level from the <PRI> prefix, else from a ``facility.severity`` word."""
    pri = extract(line, X.PRI_PATTERN, 1)
    names = literal_array(X.SYSLOG_SEVERITY)
    word = F.lower(extract(line, X.FACILITY_PATTERN, 1, ignore_case=True))
    return (F.when(pri != "", F.element_at(names, F.pmod(F.coalesce(pri.try_cast("int"), F.lit(6)), F.lit(8)) + 1))
            .otherwise(lookup(word, X.FACILITY_SEVERITY, "INFO")))


def status_level(status) -> Column:
    status = col(status).try_cast("decimal(38,0)")
    return (F.when(status.isin(503, 504), "CRITICAL").when(status >= 500, "ERROR")
            .when(status == 404, "INFO").when(status >= 400, "WARN").otherwise("INFO"))


def severity(level) -> Column:
    return lookup(F.upper(col(level)), X.SEVERITY, X.DEFAULT_SEVERITY)


def display_severity(level) -> Column:
    return lookup(F.upper(col(level)), X.DISPLAY_SEVERITY, X.DEFAULT_DISPLAY_SEVERITY)


def sort_severity(level) -> Column:
    return lookup(F.upper(col(level)), X.SORT_SEVERITY, X.DEFAULT_SORT_SEVERITY)


def scan_weight(level) -> Column:
    return lookup(col(level), X.SCAN_WEIGHT, X.DEFAULT_SCAN_WEIGHT)


def record_level(name) -> Column:
    """Level of a structured application record (logging-library names)."""
    up = F.upper(col(name))
    return lookup(up, X.RECORD_LEVEL_ALIAS, up)


def has_catastrophe(message) -> Column:
    return matches(message, "|".join(X.CATASTROPHE_PATTERNS), ignore_case=True)


def has_failure(message) -> Column:
    return matches(message, "|".join(X.FAILURE_PATTERNS), ignore_case=True)


def keep_in_report(level, message) -> Column:
    """INFO rows stay in the report only with a failure word in the message."""
    return (F.upper(col(level)) != "INFO") | contains_any(F.lower(col(message)), X.REPORT_INFO_WORDS)


def is_benign_live(level, message) -> Column:
    """Severity 5 and milder without any failure word."""
    return (severity(level) >= 5) & ~contains_any(F.lower(col(message)), X.LIVE_INFO_WORDS)
