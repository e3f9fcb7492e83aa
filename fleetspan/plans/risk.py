"""Risk intervals, landmark panels, matched sampling and target columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import odometer_at, project_odometer_to_dates
from ..functions.columns import draw
from ..operators.resample import placed, prefix

DAY = 86_400e6

#: Last day of the registry.
REGISTRY_END = "2024-01-31"


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / DAY


def km_risk(cuts: DataFrame, trips: DataFrame, lo: str, hi: str, gap_km: float) -> DataFrame:
    """entry, exit and event in km after cut + gap, for a registry window [lo, hi] placed on the odometer.

    The origin is cut + gap; entry is how far the window's start lies beyond it (0 if before); exit the event's place, or the window's end.
    """
    ids = cuts.select("vehicle_id").distinct()
    at = lambda d, n: odometer_at(ids.withColumn("_d", F.lit(d).cast("timestamp")), trips, "_d").select("vehicle_id", F.col("odo").alias(n))
    x = cuts.join(at(lo, "odo_lo"), "vehicle_id", "left").join(at(hi, "odo_hi"), "vehicle_id", "left")
    origin = F.col("cut_odo") + gap_km
    event = F.coalesce((F.col("event_odo") > F.col("odo_lo")) & (F.col("event_odo") <= F.col("odo_hi")), F.lit(False))
    return x.withColumns({"entry_km": F.greatest(F.lit(0.0), F.col("odo_lo") - origin), "exit_km": F.when(event, F.col("event_odo")).otherwise(F.col("odo_hi")) - origin, "risk_event": event.cast("int")}).drop("odo_lo", "odo_hi")


def window_risk(cuts: DataFrame, trips: DataFrame, clock: DataFrame, lo: str, hi: str, gap_km: float, horizon_km: float) -> DataFrame:
    """Registry-window risk in days from the date of cut + gap: entry, exit, event, horizon; null where the history doesn't reach it."""
    pts = cuts.select("vehicle_id", "cut_odo", (F.col("cut_odo") + gap_km).alias("_a"))
    a = project_odometer_to_dates(pts, trips, "_a").withColumnRenamed("date", "start")
    b = project_odometer_to_dates(pts.withColumn("_a", F.col("_a") + horizon_km), trips, "_a").select("vehicle_id", "cut_odo", F.col("date").alias("end"))
    x = cuts.join(a.drop("_a"), ["vehicle_id", "cut_odo"]).join(b, ["vehicle_id", "cut_odo"], "left").join(clock.select("vehicle_id", "event_date", "sale_date"), "vehicle_id", "left")
    d = lambda c: days_between(c, F.col("start"))
    w0, w1 = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
    event = F.coalesce((F.col("event_date") >= w0) & (F.col("event_date") <= w1) & (F.col("event_date") >= F.col("start")), F.lit(False))
    return x.withColumns({"entry_days": F.greatest(F.lit(0.0), d(w0)), "exit_days": F.when(event, d(F.col("event_date"))).otherwise(d(w1)), "risk_event": event.cast("int"), "horizon_days": d(F.col("end")), "cut_dss": days_between(F.col("start"), F.col("sale_date"))})


def landmark_panel(trips: DataFrame, clock: DataFrame, landmarks: list[int], window_days: int, horizon_days: int, aggs: list[Column], end: str = REGISTRY_END) -> tuple[DataFrame, DataFrame]:
    """(panel, reasons): a row per vehicle and landmark day after sale, with aggregates of the trips that end in the window before it.

    end: the day on which follow-up of vehicles without event ends.
    Vehicles without a sale date, with an event before the landmark, or without trips in the window have no row and are counted by reason.
    """
    spine = clock.withColumn("landmark", F.explode(F.array(*(F.lit(v) for v in landmarks))))
    at = F.timestamp_micros((F.unix_micros("sale_date") + F.col("landmark") * F.lit(int(DAY))).cast("long"))
    spine = spine.withColumn("at", at)
    lo = F.unix_micros("at") - F.lit(int(window_days * DAY))
    x = trips.join(spine.select("vehicle_id", "landmark", "at"), "vehicle_id").filter((F.unix_micros("t_end") > lo) & (F.col("t_end") <= F.col("at"))).groupBy("vehicle_id", "landmark").agg(F.count("*").alias("n_trips"), *aggs)
    y = spine.join(x, ["vehicle_id", "landmark"], "left")
    reason = F.when(F.col("sale_date").isNull(), "no_sale_date").when(F.col("event_date") <= F.col("at"), "event_before").when(F.col("n_trips").isNull(), "no_trips")
    y = y.withColumns({"reason": reason, "event_in": F.coalesce(days_between(F.col("event_date"), F.col("at")) <= horizon_days, F.lit(False)).cast("int"), "exit_days": days_between(F.coalesce("event_date", F.lit(end).cast("timestamp")), F.col("at"))})
    return y.filter("reason is null").drop("reason"), y.groupBy("landmark", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def match_healthy(panel: DataFrame, reference: Column, cells: list[str], shortfall: float, seed: int) -> DataFrame:
    """Healthy rows sampled to the cell distribution of the reference rows: the largest n whose quotas miss at most the given share."""
    ref = panel.filter(reference).groupBy(*cells).agg(F.count("*").alias("r"))
    have = panel.filter("event_observed = 0").groupBy(*cells).agg(F.count("*").alias("h"))
    c = ref.join(have, cells, "left").withColumns({"h": F.coalesce("h", F.lit(0)), "share": F.col("r") / F.sum("r").over(Window.partitionBy())})  # a row a cell
    total = c.agg(F.sum("h").alias("total"))
    # what is missing without rounding is the greatest of lines in n, one for each set of cells that run out first; rounding adds half a row a cell
    # at most. So the largest n lies between two roots, and only what is between them is tried
    out = Window.orderBy(F.col("h") / F.col("share"))  # a row a cell
    lines = c.select((F.sum("share").over(out) - shortfall).alias("slope"), F.sum("h").over(out).alias("had"), (F.count("*").over(Window.partitionBy()) / 2.0).alias("half"))
    root = lambda sign: F.min(F.when(F.col("slope") > 0, (F.col("had") + sign * F.col("half")) / F.col("slope")))
    most = F.greatest(F.lit(1), F.col("total"))
    total = total.crossJoin(lines.agg(root(-1).alias("lo"), root(1).alias("hi")))  # one row each
    lo, hi = F.greatest(F.lit(1), F.least(F.coalesce(F.floor("lo"), most), most)), F.least(F.coalesce(F.ceil("hi"), most), most)
    n = total.withColumn("n", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    quota = F.bround(F.col("n") * F.col("share"), 0)
    ok = c.crossJoin(n).groupBy("n").agg(F.sum(F.greatest(F.lit(0.0), quota - F.col("h"))).alias("missing")).filter(F.col("missing") <= shortfall * F.col("n"))  # cells by candidates
    best = ok.agg(F.coalesce(F.max("n"), F.lit(0)).alias("best"))
    q = c.crossJoin(best).select(*cells, F.bround(F.col("best") * F.col("share"), 0).alias("quota"))  # one row
    d = draw(seed, F.col("vehicle_id"), F.col("cut_odo").cast("bigint"))
    x = placed(panel.filter("event_observed = 0"), [d, F.col("vehicle_id"), F.col("cut_odo")], prefix(d), cells)
    return x.join(q, cells).filter(F.col("_k") <= F.col("quota")).drop("_k", "quota")


def survival_target(gap_km: float) -> dict[str, Column]:
    """duration and event with origin at cut + gap; at_risk is false where the event fell in the gap."""
    d = F.when(F.col("event_observed") == 1, F.col("time_to_event_km")).otherwise(F.col("km_after")) - gap_km
    return {"duration": d, "event": F.col("event_observed"), "at_risk": d > 0}


def ordinal_target(edges: tuple[float, ...]) -> Column:
    """0 without an event in reach, else 1 for the farthest band up to len(edges) + 1 for the nearest. edges descend."""
    t = F.col("time_to_event_km")
    c = F.lit(len(edges) + 1)
    for i in range(len(edges) - 1, -1, -1):
        c = F.when(t > edges[i], i + 1).otherwise(c)
    return F.when(t.isNull(), 0).otherwise(c)


def soft_label(horizon_km: float, far_km: float) -> Column:
    """1 up to the horizon, falling to 0 at far_km beyond it."""
    t = F.col("time_to_event_km")
    return F.when(t.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (t - horizon_km) / far_km)))


def cure_target(window_km: float) -> dict[str, Column]:
    """Event inside the window, time in it, and whether a healthy row was followed through the window."""
    t = F.when(F.col("event_observed") == 1, F.col("time_to_event_km")).otherwise(F.col("km_after"))
    inside = (F.col("event_observed") == 1) & (t <= window_km)
    return {"time": F.least(t, F.lit(window_km)), "event": inside.cast("int"), "resolved": inside | (t >= window_km)}
