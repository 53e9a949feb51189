"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_up(c: Column, digits: int) -> Column:
    """Rounding built from floor, the same in every engine."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def share(part: Column, whole: Column) -> Column:
    """0 where there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def capped(c: Column, per: float, cap: float) -> Column:
    """``c / per``, at most ``cap``; null counts as 0."""
    return F.least(F.lit(cap), F.coalesce(c, F.lit(0)) / per)


def steps(c: Column, bounds: list[tuple[float, float]], otherwise: float, unknown: float) -> Column:
    """The value of the first bound that lies above ``c``."""
    out = F.when(c.isNull(), F.lit(unknown))
    for bound, value in bounds:
        out = out.when(c < bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))
