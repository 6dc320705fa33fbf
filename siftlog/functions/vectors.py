"""Array-valued vector arithmetic and the score cap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed as X
from .base import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` bound to a lambda variable, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_normalize(v) -> Column:
    """Unit length; a zero vector stays as it is."""
    def divide(s: Column) -> Column:
        n = s.getField("n")
        return F.transform(s.getField("v"), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))

    return let(col(v), lambda bound: let(F.struct(bound.alias("v"), l2_norm(bound).alias("n")), divide))


def scaled(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(weight))


def combine_blocks(text, extra, weight: float) -> Column:
    """(1-w)·norm(text) followed by w·norm(extra), normalised again."""
    return row_normalize(F.concat(scaled(row_normalize(text), 1.0 - weight), scaled(row_normalize(extra), weight)))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def soft_cap(raw) -> Column:
    raw = col(raw)
    start, tau = X.SOFTCAP_START, X.SOFTCAP_TAU
    capped = F.lit(start) + F.lit(1.0 - start) * (F.lit(1.0) - F.exp(-(raw - F.lit(start)) / F.lit(tau)))
    return F.when(raw <= start, F.greatest(F.lit(0.0), raw)).otherwise(capped)
