"""Rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round on the scaled double with ties to the even digit."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def engagement_rate(metric: Column, digits: int = 2) -> Column:
    """Share of a group's rows whose metric is above zero; null when no row is."""
    hits = F.nullif(F.count_if(metric > 0), F.lit(0))
    return round_half_even(percent(hits, F.count(F.lit(1))), digits)


def all_below(bounds: dict[str, float]) -> Column:
    """True where every named column is strictly below its bound; null values fail."""
    test = F.lit(True)
    for name, bound in bounds.items():
        test = test & F.coalesce(F.col(name) < F.lit(bound), F.lit(False))
    return test
