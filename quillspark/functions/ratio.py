"""Ratios and intervals with defined empty cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile of a two-sided 95 % interval.
Z = 1.959963984540054


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty).cast("double"))


def wilson(hits: Column, n: Column, empty: float | None = None) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval; ``empty`` at both ends where n is 0."""
    k, m = hits.cast("double"), F.when(n > 0, n).cast("double")
    p, zz = k / m, F.lit(Z * Z)
    scale, centre = 1 + zz / m, p + zz / (2 * m)
    half = F.lit(Z) * F.sqrt((p * (1 - p) + zz / (4 * m)) / m)
    fill = F.lit(empty).cast("double")
    return F.coalesce((centre - half) / scale, fill), F.coalesce((centre + half) / scale, fill)


def f1(tp: Column, fp: Column, fn: Column, empty: float | None = None) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, empty)
