"""Adapter of generic event and customer tables to the telemetry data model: trips, vehicles, event dates, scores."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .layout import KeyedStore

ORIGIN = "2023-12-01"
WINDOW_KM, GAP_KM, HORIZON_KM, STEP_KM = 400.0, 100.0, 800.0, 100.0
CONTEXT_KM, BIN_KM, SUSTAIN = 1000.0, 25.0, 2
REGISTRY = ("2024-01-05", "2024-01-25")


class Fleet:
    """The tables of one folder, in the shapes that the operators take. Everything is lazy.

    With a store (or a folder for one in spark.fleetspan.store), trips are written there once, dealt by vehicle; without, each query derives them from the events.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: KeyedStore | None = None):
        self.spark, self.dir = spark, sf_dir
        where = spark.conf.get("spark.fleetspan.store", None)
        self.store = store or (KeyedStore(spark, where) if where else None)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Events as trips without odometer."""
        cents = F.round(F.col("value") * 100).cast("bigint")
        start = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("user_id").alias("vehicle_id"), "event_id", F.col("event_type").alias("message"), "value", start.alias("t_start"),
            F.timestamp_micros(F.unix_micros(start) + cents * 600000).alias("t_end"), cents.alias("cents"),
            F.when(F.col("event_type") == "view", F.lit(0).cast("bigint")).otherwise(cents).alias("km_c"),
            F.get_json_object("props", "$.k").cast("double").alias("level_end"))

    @cached_property
    def trips(self) -> DataFrame:
        if self.store is None:
            return self.derived_trips
        return self.store.get("trips", lambda: self.derived_trips, "vehicle_id", ["t_start", "event_id"], [f"{self.dir}/events.parquet"])

    @cached_property
    def derived_trips(self) -> DataFrame:
        """One row per trip: vehicle_id, event_id, message, value, t_start, t_end, trip_km, level_start, level_end, odo_start, odo_end."""
        by = Window.partitionBy("vehicle_id").orderBy("t_start", "event_id")
        x = self.events.withColumns({"level_start": F.lag("level_end").over(by), "odo_c": F.sum("km_c").over(by.rowsBetween(Window.unboundedPreceding, 0))})
        return x.withColumns({"trip_km": F.col("km_c") / 100.0, "odo_end": F.col("odo_c") / 100.0, "odo_start": (F.col("odo_c") - F.col("km_c")) / 100.0})

    @cached_property
    def vehicles(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("vehicle_id"), (F.col("c_nationkey") % 5).alias("market"), F.col("c_mktsegment").alias("engine"), (k % 10).alias("production_day"), (20 + k % 7).alias("days_until_sale"),
            F.when(k % 3 == 0, 40 + (k * 7) % 12).alias("event_day"), F.when(k % 3 == 0, "failed").otherwise("healthy").alias("cohort"), F.col("c_acctbal").alias("acctbal"))

    @cached_property
    def event_dates(self) -> DataFrame:
        from ..operators.asof import day_on_calendar

        dates = self.vehicles.filter("event_day is not null").select("vehicle_id", day_on_calendar(F.lit(ORIGIN), F.col("event_day")).alias("event_date"))
        return self.store.deal(dates, "vehicle_id") if self.store else dates

    @cached_property
    def event_odo(self) -> DataFrame:
        from ..operators.asof import project_dates_to_odometer

        return project_dates_to_odometer(self.event_dates, self.trips, "event_date")

    @cached_property
    def cuts(self) -> DataFrame:
        from ..plans.panel import cut_grid

        return cut_grid(self.trips, self.event_odo.select("vehicle_id", "event_odo"), WINDOW_KM, GAP_KM, HORIZON_KM, STEP_KM)

    @cached_property
    def windowed(self) -> DataFrame:
        """Every trip with every cut whose window holds it."""
        from ..plans.panel import window_rows

        return window_rows(self.trips, self.cuts, WINDOW_KM, STEP_KM)

    @cached_property
    def scores(self) -> DataFrame:
        """Predictions for metric queries: the mean level of the window. Kept, as metrics read them several times; a row a cut is little."""
        keys = ["vehicle_id", "cut_odo", "label", "event_observed", "time_to_event_km", "km_after"]
        return self.windowed.groupBy(*keys).agg(F.round(F.avg("level_end") / 100, 6).alias("score")).persist()
