"""Timestamps of log lines as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X
from .base import ascii_digits, extract, lookup, strip


def _epoch(year, month, day, clock) -> Column:
    """Epoch seconds of a UTC wall-clock time, NULL when the date does not exist."""
    part = F.split(clock, ":")
    stamp = F.try_make_timestamp(
        year.cast("int"), month.cast("int"), day.cast("int"),
        F.get(part, F.lit(0)).cast("int"), F.get(part, F.lit(1)).cast("int"),
        F.get(part, F.lit(2)).cast("decimal(16,6)"), F.lit("UTC"))
    real = F.get(part, F.lit(2)).cast("int") < 60          # second 60 does not roll over
    return F.when(real, F.unix_micros(stamp) / F.lit(1000000)).cast("double")


def parse_timestamp(text, year: int, respect_offset: bool = False) -> Column:
    """Epoch seconds (DOUBLE) of the first time stamp form found in ``text``.

    Fractions and zone offsets of ISO stamps are ignored unless
    ``respect_offset``; stamps without a year get ``year``.
    """
    t = ascii_digits(strip(text))
    months = {m: i + 1 for i, m in enumerate(X.MONTHS)}

    sec, millis = extract(t, X.EPOCH_PATTERN, 1), extract(t, X.EPOCH_PATTERN, 2)
    epoch = sec.cast("double") + F.when(millis != "", millis.cast("double") / 1000.0).otherwise(F.lit(0.0))

    date, clock = F.split(extract(t, X.ISO_PATTERN, 1), "-"), extract(t, X.ISO_PATTERN, 2)
    iso = _epoch(F.get(date, F.lit(0)), F.get(date, F.lit(1)), F.get(date, F.lit(2)), clock)
    if respect_offset:
        zone = extract(t, X.ISO_PATTERN, 4)
        digits = F.regexp_replace(zone, "[^0-9]", "")
        shift = (F.left(digits, F.lit(2)).cast("int") * 3600 + F.right(digits, F.lit(2)).cast("int") * 60)
        iso = iso - F.when(zone.rlike(r"^\+"), shift).when(zone.startswith("-"), -shift).otherwise(F.lit(0))
        iso = iso + F.coalesce(extract(t, X.ISO_PATTERN, 3).cast("double"), F.lit(0.0))

    syslog = _epoch(F.lit(year), lookup(extract(t, X.SYSLOG_TIME_PATTERN, 1), months, None),
                    extract(t, X.SYSLOG_TIME_PATTERN, 2), extract(t, X.SYSLOG_TIME_PATTERN, 3))
    access = _epoch(extract(t, X.ACCESS_TIME_PATTERN, 3), lookup(extract(t, X.ACCESS_TIME_PATTERN, 2), months, None),
                    extract(t, X.ACCESS_TIME_PATTERN, 1), extract(t, X.ACCESS_TIME_PATTERN, 4))
    return (F.when(sec != "", epoch)
            .when(clock != "", iso)
            .when(extract(t, X.SYSLOG_TIME_PATTERN, 1) != "", syslog)
            .when(extract(t, X.ACCESS_TIME_PATTERN, 3) != "", access))


def window_index(epoch: Column, start: Column, seconds: float) -> Column:
    return F.floor((epoch - start) / F.lit(float(seconds)))
