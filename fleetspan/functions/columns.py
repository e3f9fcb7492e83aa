"""Column functions that several operators share. Missing values are nulls throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(cond, F.lit(False))


def null_safe_clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """clip that keeps nulls; least and greatest alone would take the bound for them."""
    y = x if hi is None else F.least(x, F.lit(hi))
    y = y if lo is None else F.greatest(y, F.lit(lo))
    return F.when(x.isNotNull(), y)


def pct(x: Column, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(x, F.lit(p))


def interpolate(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear between two points; y0 at an exact hit or a zero span; null if either end is missing."""
    return F.when(x0.isNull() | x1.isNull(), None).when(x1 <= x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0).cast("double"))


def day_on_calendar(origin: Column, days: Column) -> Column:
    """Timestamp of a day number counted from origin (a date or its text)."""
    return F.timestamp_micros(F.unix_micros(origin.cast("timestamp")) + days.cast("long") * F.lit(86_400_000_000))


def draw(*parts) -> Column:
    """A key to order by at random: md5 of the parts, joined by '|'."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def uniform(*parts) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.conv(F.substring(draw(*parts), 1, 12), 16, 10).cast("double") / float(1 << 48)


def natural_spline(x: Column, knots: tuple[float, ...]) -> list[Column]:
    """Columns of the natural cubic basis: linear beyond the end knots."""
    k = sorted(knots)
    cube = lambda t: F.pow(F.greatest(x - t, F.lit(0.0)), 3)
    d = lambda i: (cube(k[i]) - cube(k[-1])) / (k[-1] - k[i])
    return [x, *(d(i) - d(len(k) - 2) for i in range(len(k) - 2))]
