"""Small Column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from .fixed import FLAGS, FLAGS_I


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern(text: str, ignore_case: bool = False, unicode: bool = True) -> str:
    """A pattern with the flags that give it Unicode classes and plain newlines."""
    if unicode:
        return (FLAGS_I if ignore_case else FLAGS) + text
    return ("(?di)" if ignore_case else "(?d)") + text


def matches(c: Column | str, text: str, ignore_case: bool = False) -> Column:
    """True when ``text`` is found.  ASCII rows take the cheaper ASCII classes."""
    c = col(c)
    return F.when(is_ascii(c), c.rlike(pattern(text, ignore_case, False))).otherwise(
        c.rlike(pattern(text, ignore_case)))


def extract(c: Column | str, text: str, group: int = 0, ignore_case: bool = False, unicode: bool = True) -> Column:
    return F.regexp_extract(col(c), pattern(text, ignore_case, unicode), group)


def extract_all(c: Column | str, text: str, group: int = 0, ignore_case: bool = False, unicode: bool = True) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern(text, ignore_case, unicode)), F.lit(group))


def by_script(c: Column | str, body: Callable[[Column, bool], Column]) -> Column:
    """``body(text, unicode)`` with the cheaper ASCII classes for ASCII rows; the digits of other rows become 0-9."""
    c = col(c)
    return F.when(is_ascii(c), body(c, False)).otherwise(body(ascii_digits(c), True))


def is_ascii(c: Column | str) -> Column:
    """Byte length equals character length only for ASCII text."""
    c = col(c)
    return F.octet_length(c) == F.char_length(c)


_DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if c.isdecimal()]


def ascii_digits(c: Column | str) -> Column:
    """Decimal digits of every script as 0-9, so that what a pattern finds can be cast."""
    c = col(c)
    plain = F.translate(c, "".join(_DIGITS), "".join(str(int(d)) for d in _DIGITS))
    return F.when(is_ascii(c), c).otherwise(plain)


def strip(c: Column | str) -> Column:
    """Drop leading and trailing white space of every kind, not only blanks."""
    c = col(c)
    needs = c.rlike(r"(?U)^\s|\s$")
    return F.when(needs, F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"(?U)\S")


def _sql(value) -> str:
    return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value) + ("D" if isinstance(value, float) else "")


def literal_map(entries: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in entries.items()) + ")")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(_sql(v) for v in values) + ")")


def lookup(key: Column, entries: dict, default) -> Column:
    """Fixed-table lookup with a default for unknown keys."""
    found = F.try_element_at(literal_map(entries), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any of the plain words occurs in the text, in one pass."""
    return c.rlike("|".join(words))


def holds_any(c: Column, words: list[str]) -> Column:
    """``contains_any`` by plain searches, each cheaper than a pattern."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])
