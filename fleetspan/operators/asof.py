"""As-of joins by union and window: one shuffle by key, no range join and no per-key Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day_on_calendar, interpolate  # noqa: F401


def neighbours(points: DataFrame, axis: DataFrame, key: str, point: str, on: str, values: list[str]) -> DataFrame:
    """points with ``<v>_before`` and ``<v>_after`` for on and each of values: the nearest axis rows at or before, and at or after.

    Ties on the axis: backward takes the greatest first value, forward the least. points may hold several rows per key.
    """
    kept = [c for c in points.columns if c != key]
    p = points.select(key, F.col(point).alias("_x"), F.lit(1).alias("_side"), F.struct(*kept).alias("_p"), F.lit(None).cast(axis.select(F.struct(on, *values).alias("a")).schema["a"].dataType).alias("_a"))
    a = axis.select(key, F.col(on).alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(on, *values).alias("_a"))
    both = p.unionByName(a)
    tie = F.col("_a")[values[0]]
    back = Window.partitionBy(key).orderBy("_x", "_side", tie.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col("_x").desc(), "_side", tie.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_a", ignorenulls=True).over(back)).withColumn("_f", F.last("_a", ignorenulls=True).over(ahead)).filter("_side = 1")
    cols = [F.col("_p")[c].alias(c) for c in kept]
    for c in [on, *values]:
        cols += [F.col("_b")[c].alias(f"{c}_before"), F.col("_f")[c].alias(f"{c}_after")]
    return both.select(key, *cols)


def backward(points: DataFrame, axis: DataFrame, key: str, point: str, on: str, values: list[str]) -> DataFrame:
    """points with values of the last axis row at or before point."""
    x = neighbours(points, axis, key, point, on, values)
    return x.select(*points.columns, *(F.col(f"{v}_before").alias(v) for v in values))


def project_dates_to_odometer(dates: DataFrame, axis: DataFrame, date: str, key: str = "vehicle_id", on: str = "t_start", odo: str = "odo_end") -> DataFrame:
    """dates with odo_before, odo_after, source (interpolated, exact, before_history, after_history) and event_odo. Keys without history drop out."""
    x = neighbours(dates, axis, key, date, on, [odo])
    b, a, us = F.col(f"{odo}_before"), F.col(f"{odo}_after"), lambda c: F.unix_micros(c)
    exact = F.col(f"{on}_before") == F.col(f"{on}_after")
    y = interpolate(us(date), us(f"{on}_before"), us(f"{on}_after"), b, a)
    source = F.when(b.isNull(), "before_history").when(a.isNull(), "after_history").when(exact, "exact").otherwise("interpolated")
    return x.filter(b.isNotNull() | a.isNotNull()).select(*dates.columns, b.alias("odo_before"), a.alias("odo_after"), source.alias("source"), F.when(exact, b).otherwise(F.coalesce(y, b, a)).alias("event_odo"))


def project_odometer_to_dates(points: DataFrame, axis: DataFrame, point: str, key: str = "vehicle_id", on: str = "t_start", odo: str = "odo_end") -> DataFrame:
    """points with date: when the running-max odometer first reaches point, interpolated in time; null outside the history."""
    by = Window.partitionBy(key).orderBy(on, odo).rowsBetween(Window.unboundedPreceding, 0)
    top = axis.withColumn("_top", F.max(odo).over(by)).groupBy(key, "_top").agg(F.min(on).alias("_t"), F.max(on).alias("_last"))
    x = neighbours(points, top.withColumn("_us", F.unix_micros("_t")).withColumn("_us_last", F.unix_micros("_last")), key, point, "_top", ["_us", "_us_last"])
    y = interpolate(F.col(point), F.col("_top_before"), F.col("_top_after"), F.col("_us_last_before"), F.col("_us_after"))
    hit = F.col("_top_before") == F.col("_top_after")
    return x.select(*points.columns, F.timestamp_micros(F.when(hit, F.col("_us_before")).otherwise(F.round(y)).cast("long")).alias("date"))


def forward_date(points: DataFrame, axis: DataFrame, point: str, key: str = "vehicle_id", on: str = "t_start", odo: str = "odo_end") -> DataFrame:
    """points with date: the first axis row at or beyond point on the odometer; no interpolation."""
    x = neighbours(points, axis, key, point, odo, [on])
    return x.select(*points.columns, F.col(f"{on}_after").alias("date"))


def nearest(points: DataFrame, axis: DataFrame, key: str, point: str, on: str, values: list[str], tolerance_s: float) -> DataFrame:
    """points with values of the nearest axis row (backward at equal distance) within the tolerance, and gap_s."""
    x = neighbours(points, axis, key, point, on, values)
    back = F.unix_micros(point) - F.unix_micros(f"{on}_before")
    ahead = F.unix_micros(f"{on}_after") - F.unix_micros(point)
    use_back = F.coalesce(back <= ahead, back.isNotNull())
    gap = F.when(use_back, back).otherwise(ahead) / 1e6
    ok = gap <= tolerance_s
    return x.select(*points.columns, *(F.when(ok, F.when(use_back, F.col(f"{v}_before")).otherwise(F.col(f"{v}_after"))).alias(v) for v in values), F.when(ok, gap).alias("gap_s"))


def odometer_at(points: DataFrame, axis: DataFrame, point: str, key: str = "vehicle_id", on: str = "t_start", odo: str = "odo_end") -> DataFrame:
    """points with odo: linear interpolation, clamped to the ends of the history."""
    x = project_dates_to_odometer(points, axis, point, key, on, odo)
    return x.select(*points.columns, F.col("event_odo").alias("odo"))
