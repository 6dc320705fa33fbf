"""The fourteen row-local features of a log entry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X
from .base import by_script, col, extract, extract_all, holds_any, is_ascii, literal_array, lookup, matches
from .text import normalize_token, synonym_map
from .vectors import let

FEATURE_NAMES = [
    "level_score", "error_score", "http_score", "has_number", "max_number", "length_score",
    "has_stack", "has_ip", "has_port", "has_duration", "max_duration", "has_memory",
    "repeat_score", "has_service",
]


def _flag(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def _http_code(message: Column) -> Column:
    """Text of the first status code, from one match: the code ends the match, but for white space; empty without one."""
    found = by_script(message, lambda c, u: extract(c, X.HTTP_PATTERN, 0, ignore_case=True, unicode=u))
    return extract(found, r"([1-5]\d{2})\s*$", 1)


def http_status(message) -> Column:
    """First status code that stands in an HTTP context, NULL when there is none."""
    return _http_code(col(message)).try_cast("int")


def _feature_words(low: Column) -> Column:
    """How many feature words the normalised text holds.

    No feature word holds a blank, and the rules turn a lower-case word into a
    synonym, the word for an error code, or parts of itself.  So only words
    with one of the ``FEATURE_SIGNS`` can count, and only they are normalised.
    """
    table = synonym_map()
    signs = "|".join(X.FEATURE_SIGNS)
    words = F.filter(F.regexp_extract_all(low, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), lambda t: t.rlike(signs))
    normalized = F.array_join(F.transform(words, lambda t: normalize_token(t, table)), " ")
    hits = let(normalized, lambda text: F.size(F.filter(literal_array(X.FEATURE_WORDS), lambda w: F.contains(text, w))))
    return F.when(holds_any(low, X.FEATURE_SIGNS), hits).otherwise(F.lit(0))


def feature_columns(level, service, message) -> dict[str, Column]:
    message, service = col(message), col(service)
    low = F.lower(message)

    hits = _feature_words(low)
    numbers = by_script(low, lambda c, u: extract_all(c, X.NUMBER_PATTERN, 1, unicode=u))
    top = F.array_max(F.transform(numbers, lambda n: n.try_cast("double")))
    # a match holds its number and its unit: the text is searched once for both
    last = F.try_element_at(by_script(low, lambda c, u: extract_all(c, X.DURATION_PATTERN, unicode=u)), F.lit(-1))
    unit = F.regexp_extract(last, "[a-z]+$", 0)
    seconds = (F.regexp_extract(last, r"^[0-9]+\.?[0-9]*", 0).try_cast("double")
               * lookup(unit, {"minutes": 60.0, "min": 60.0}, 1.0) / lookup(unit, {"ms": 1000.0}, 1.0))
    # an ASCII row without the letters of a unit has no size
    memory = F.when(is_ascii(low) & ~holds_any(low, X.MEMORY_UNITS), F.lit(False)).otherwise(
        matches(low, X.MEMORY_PATTERN, ignore_case=True))
    repeats = by_script(low, lambda c, u: extract(c, X.REPEAT_PATTERN, 1, ignore_case=True, unicode=u))

    values = [
        lookup(F.upper(col(level)), X.FEATURE_LEVEL_WEIGHT, X.DEFAULT_FEATURE_LEVEL_WEIGHT),
        hits / F.lit(float(len(X.FEATURE_WORDS))),
        lookup(F.left(_http_code(message), F.lit(1)), {"5": 1.0, "4": 0.5}, 0.0),
        _flag(top.isNotNull()),
        F.coalesce(F.least(F.log10(1.0 + top) / 9.0, F.lit(1.0)), F.lit(0.0)),
        F.least(F.char_length(message) / 200.0, F.lit(1.0)),
        _flag(holds_any(low, X.STACK_WORDS)),
        _flag(matches(low, X.IP_PATTERN)),
        _flag(matches(low, X.PORT_PATTERN)),
        _flag(last.isNotNull()),
        F.coalesce(F.least(F.log1p(seconds) / 10.0, F.lit(1.0)), F.lit(0.0)),
        _flag(memory),
        F.when(repeats != "", F.least(repeats.try_cast("double") / 100.0, F.lit(1.0))).otherwise(F.lit(0.0)),
        _flag(~F.lower(F.coalesce(service, F.lit(""))).isin("", "unknown")),
    ]
    return dict(zip(FEATURE_NAMES, values))


def feature_vector(level, service, message) -> Column:
    return F.array(*feature_columns(level, service, message).values())
