"""Row derivations of trips and messages: clips, flags, rest times, level changes, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, null_safe_clip



def by_time():
    """A vehicle's rows in order."""
    return Window.partitionBy("vehicle_id").orderBy("t_start", "event_id")


SEVERE, NORMAL = "error", "signup"
MESSAGES = ("click", "error", "purchase", "signup", "view")


def valid_trips(rows: DataFrame) -> DataFrame:
    """Rows with an odometer and without negative km."""
    return rows.filter(F.col("odo_end").isNotNull() & (F.col("trip_km") >= 0))


def valid_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("odo_end").isNull()).alias("n_no_odo"), F.count_if(F.col("trip_km") < 0).alias("n_negative"))


def clip_columns(rows: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return rows.withColumns({c: null_safe_clip(F.col(c), lo, hi) for c, (lo, hi) in limits.items()})


def trip_columns(rows: DataFrame) -> DataFrame:
    """minutes, kmh (null on idle trips), flags, level changes, fuel per 100 km on valid trips, masked columns."""
    minutes = (F.unix_micros("t_end") - F.unix_micros("t_start")) / 60e6
    km, lvl, before = F.col("trip_km"), F.col("level_end"), F.col("level_start")
    moving = flag(km > 0)
    delta = lvl - before
    return rows.withColumns({
        "minutes": minutes, "kmh": F.when(moving, F.try_divide(km, minutes / 60)), "idle": flag(km <= 0), "moving": moving, "short": flag((km > 0) & (km < 20)),
        "urban": flag((km > 0) & (F.try_divide(km, minutes / 60) <= 30)), "cold_start": flag(before < 20), "level_delta": delta, "regen_drop": F.when(delta < 0, -delta),
        "saturated": flag(lvl >= 95), "abnormal": flag(F.col("message") == SEVERE), "cleaning": flag(F.col("message") == "purchase"), "manual": flag(F.col("message") == NORMAL),
        "fuel_100km": F.when(flag((km >= 5) & (before > lvl)), (before - lvl) / F.nullif(km, F.lit(0.0)) * 100), "level_end_moving": F.when(moving, lvl), "amplitude": F.abs(delta),
    })


def message_flags(rows: DataFrame, levels: tuple[str, ...] = MESSAGES) -> DataFrame:
    """One flag per level, abnormal (severe), any and the marker; rows without odometer drop out."""
    x = rows.filter("odo_end is not null")
    return x.withColumns({f"msg_{m}": flag(F.col("message") == m).cast("int") for m in levels} | {"msg_any": F.col("message").isNotNull().cast("int"), "msg_severe": flag(F.col("message") == SEVERE).cast("int")})


def unknown_messages(rows: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """Levels outside the vocabulary, with their counts."""
    return rows.filter(F.col("message").isNotNull() & ~F.col("message").isin(*levels)).groupBy("message").agg(F.count("*").alias("n"))


def rest_times(rows: DataFrame, chained_s: float = 3600) -> DataFrame:
    """Hours since the previous trip's end, not below 0, and whether the trip follows within chained_s."""
    gap = (F.unix_micros("t_start") - F.unix_micros(F.lag("t_end").over(by_time()))) / 3600e6
    x = rows.withColumn("rest_h", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))))
    return x.withColumn("chained", flag(F.col("rest_h") * 3600 <= chained_s))


def level_changes(rows: DataFrame) -> DataFrame:
    """Rise and drop of the level since the previous message."""
    d = F.col("level_end") - F.lag("level_end").over(by_time())
    return rows.withColumns({"rise": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "drop": F.when(d.isNotNull(), F.greatest(F.lit(0.0) - d, F.lit(0.0)))})


def transitions_of_messages(rows: DataFrame, first: str, then: tuple[str, ...]) -> DataFrame:
    """Per vehicle: how often a first message is followed by each of then."""
    x = rows.withColumn("next", F.lead("message").over(by_time()))
    return x.groupBy("vehicle_id").agg(F.count_if(F.col("message") == first).alias("n_first"), *(F.count_if((F.col("message") == first) & (F.col("next") == m)).alias(f"to_{m}") for m in then))


def enrich(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Exploratory columns: km_to_event, night, weekend, long idle, stop flags. events: (vehicle_id, event_odo)."""
    h, d = F.hour("t_start"), F.dayofweek("t_start")
    return rows.join(events, "vehicle_id", "left").withColumns({
        "km_to_event": F.col("event_odo") - F.col("odo_end"), "night": (h >= 22) | (h < 6), "weekend": d.isin(1, 7),
        "long_idle": flag((F.col("trip_km") <= 0) & (F.unix_micros("t_end") - F.unix_micros("t_start") > 15 * 60_000_000)), "stopped": flag(F.col("message") == SEVERE), "cleaned": flag(F.col("message") == "purchase")})


def vehicle_clock(vehicles: DataFrame, origin: str) -> DataFrame:
    """production_date, sale_date, event_date and event_dss (days since sale) on the calendar that begins at origin."""
    from .asof import day_on_calendar

    o = F.lit(origin)
    return vehicles.withColumns({
        "production_date": day_on_calendar(o, F.col("production_day")), "sale_date": day_on_calendar(o, F.col("production_day") + F.col("days_until_sale")), "event_date": day_on_calendar(o, F.col("event_day")),
        "event_dss": F.col("event_day") - F.col("production_day") - F.col("days_until_sale")})


def annotate(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """Trips with age and days since sale, month, post_sale and before_event."""
    c = clock.select("vehicle_id", "production_date", "sale_date", "event_date")
    days = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / 86_400e6)
    return rows.join(c, "vehicle_id", "left").withColumns({
        "age_days": days("t_start", "production_date"), "dss": days("t_start", "sale_date"), "month": F.date_format("t_start", "yyyy-MM"),
        "post_sale": flag(F.col("t_start") >= F.col("sale_date")), "before_event": F.col("event_date").isNull() | (F.col("t_start") <= F.col("event_date"))})


def shift_days(x: Column, days: float) -> Column:
    """A timestamp moved by days, earlier if negative."""
    return F.timestamp_micros(F.unix_micros(x) + F.lit(int(days * 86_400_000_000)))


def pre_event(rows: DataFrame) -> DataFrame:
    """No row after the event; rows need event_odo."""
    return rows.filter("event_odo is null or odo_end <= event_odo")


def intervention_markers(rows: DataFrame, gap_h: float = 24, drop: float = 40, jump_km: float = 150) -> DataFrame:
    """Intervals (a, b, marker) between rows in which someone may have worked on the vehicle: long gap, level drop off trips, odometer jump, manual cleaning."""
    x = rows.withColumns({"a": F.lag("t_end").over(by_time()), "l0": F.lag("level_end").over(by_time()), "o0": F.lag("odo_end").over(by_time())})
    rules = [("long_gap", F.unix_micros("t_start") - F.unix_micros("a") > gap_h * 3600e6), ("drop_off_trip", F.col("l0") - F.col("level_end") >= drop), ("odo_jump", F.col("odo_end") - F.col("o0") > jump_km), ("manual", F.col("message") == NORMAL)]
    found = F.filter(F.array(*(F.when(flag(c), F.lit(m)) for m, c in rules)), lambda m: m.isNotNull())
    return x.filter("a is not null").withColumn("marker", F.explode(found)).select("vehicle_id", F.least("a", "t_start").alias("a"), F.greatest("a", "t_start").alias("b"), "marker")


def usable_event(event_day: Column, lo: int, hi: int) -> Column:
    """Event days strictly inside (lo, hi); missing days aren't usable."""
    return flag((event_day > lo) & (event_day < hi))


def select_universe(vehicles: DataFrame, criteria: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(vehicles that meet all criteria, report of drops by the first criterion failed)."""
    reason = F.lit(None).cast("string")
    for name in reversed(list(criteria)):
        reason = F.when(~flag(criteria[name]), name).otherwise(reason)
    x = vehicles.withColumn("reason", reason)
    return x.filter("reason is null").drop("reason"), x.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def columns_by_prefix(rows: DataFrame, *prefixes: str) -> list[str]:
    return [c for p in prefixes for c in rows.columns if c.startswith(p)]


def contract_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, then feat_, static_, aux_, then the rest."""
    order = [*keys, *columns_by_prefix(rows, "feat_", "static_", "aux_")]
    return rows.select(*order, *(c for c in rows.columns if c not in order))


def promote(rows: DataFrame, aux: list[str]) -> DataFrame:
    """aux_ columns as features."""
    return rows.withColumnsRenamed({c: "feat_" + c.removeprefix("aux_") for c in aux})
