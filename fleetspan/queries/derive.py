"""Queries of projections, filters and ordered per-vehicle logic (P, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, joins
from ..sources.fleet import ORIGIN
from .registry import query

MIN = "date_diff('microsecond',t_start,t_end)/60000000.0::DOUBLE"


@query("p01_valid_trips", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_no_odo, CAST(0 AS BIGINT) AS n_negative FROM trips")
def p01(f):
    return derive.valid_report(f.trips)


@query("p02_clip", "SELECT event_id, round(greatest(5.0::DOUBLE, least(150.0::DOUBLE, value)),4) AS value, CASE WHEN level_start IS NOT NULL THEN greatest(10.0::DOUBLE, level_start) END AS level_start FROM trips")
def p02(f):
    return derive.clip_columns(f.trips, {"value": (5.0, 150.0), "level_start": (10.0, None)}).select("event_id", F.round("value", 4).alias("value"), "level_start")


@query("p03_trip_km_minutes_speed", f"SELECT event_id, trip_km, round({MIN},4) AS minutes, CASE WHEN trip_km>0 AND ({MIN})<>0 THEN round(trip_km/(({MIN})/60),4) END AS kmh FROM trips")
def p03(f):
    return derive.trip_columns(f.trips).select("event_id", "trip_km", F.round("minutes", 4).alias("minutes"), F.round("kmh", 4).alias("kmh"))


@query("p04_usage_flags", f"SELECT event_id, trip_km<=0 AS idle, trip_km>0 AS moving, trip_km>0 AND trip_km<20 AS short, coalesce(trip_km>0 AND trip_km/nullif(({MIN})/60,0)<=30, false) AS urban, coalesce(level_start<20,false) AS cold_start, abs(level_end-level_start) AS amplitude FROM trips")
def p04(f):
    return derive.trip_columns(f.trips).select("event_id", "idle", "moving", "short", "urban", "cold_start", "amplitude")


@query("p05_level_derivations", "SELECT event_id, level_end-level_start AS level_delta, CASE WHEN level_end<level_start THEN level_start-level_end END AS regen_drop, level_end>=95 AS saturated, message='error' AS abnormal, message='purchase' AS cleaning, message='signup' AS manual FROM trips")
def p05(f):
    return derive.trip_columns(f.trips).select("event_id", "level_delta", "regen_drop", "saturated", "abnormal", "cleaning", "manual")


@query("p06_fuel_per_100km", "SELECT event_id, CASE WHEN trip_km>=5 AND level_start>level_end THEN round((level_start-level_end)/trip_km*100,6) END AS fuel_100km FROM trips")
def p06(f):
    return derive.trip_columns(f.trips).select("event_id", F.round("fuel_100km", 6).alias("fuel_100km"))


@query("p07_masked_columns", "SELECT event_id, CASE WHEN trip_km>0 THEN level_end END AS level_end_moving FROM trips")
def p07(f):
    return derive.trip_columns(f.trips).select("event_id", "level_end_moving")


@query("p08_message_one_hot", "SELECT vehicle_id, " + ", ".join(f"count(*) FILTER (message='{m}') AS msg_{m}" for m in derive.MESSAGES) + ", count(*) AS msg_any FROM trips GROUP BY 1")
def p08(f):
    x = derive.message_flags(f.trips)
    return x.groupBy("vehicle_id").agg(*(F.sum(f"msg_{m}").alias(f"msg_{m}") for m in (*derive.MESSAGES, "any")))


@query("p09_unknown_messages", "SELECT message, count(*) AS n FROM trips WHERE message NOT IN ('click','error') GROUP BY 1")
def p09(f):
    return derive.unknown_messages(f.trips, ("click", "error"))


@query("p10_severity_flag", "SELECT vehicle_id, count(*) FILTER (message='error') AS severe FROM trips GROUP BY 1")
def p10(f):
    return derive.message_flags(f.trips).groupBy("vehicle_id").agg(F.sum("msg_severe").alias("severe"))


@query("p11_exploratory_enrichment", """SELECT event_id, round(event_odo-odo_end,4) AS km_to_event, (hour(t_start)>=22 OR hour(t_start)<6) AS night, dayofweek(t_start) IN (0,6) AS weekend, trip_km<=0 AND date_diff('microsecond',t_start,t_end)>900000000 AS long_idle
  FROM trips LEFT JOIN event_odo USING (vehicle_id)""")
def p11(f):
    x = derive.enrich(f.trips, f.event_odo.select("vehicle_id", "event_odo"))
    return x.select("event_id", F.round("km_to_event", 4).alias("km_to_event"), "night", "weekend", "long_idle")


@query("p12_clock_annotation", """SELECT event_id, CAST(floor((epoch_us(t_start)-epoch_us(p))/86400000000) AS BIGINT) AS age_days, CAST(floor((epoch_us(t_start)-epoch_us(s))/86400000000) AS BIGINT) AS dss, strftime(t_start,'%Y-%m') AS month, t_start>=s AS post_sale, coalesce(t_start<=e,true) AS before_event
  FROM trips JOIN (SELECT vehicle_id, TIMESTAMP '2023-12-01'+to_days(CAST(production_day AS INTEGER)) AS p, TIMESTAMP '2023-12-01'+to_days(CAST(production_day+days_until_sale AS INTEGER)) AS s, TIMESTAMP '2023-12-01'+to_days(CAST(event_day AS INTEGER)) AS e FROM vehicles) USING (vehicle_id)""")
def p12(f):
    return derive.annotate(f.trips, derive.vehicle_clock(f.vehicles, ORIGIN)).select("event_id", "age_days", "dss", "month", "post_sale", "before_event")


@query("p13_vehicle_clock", "SELECT vehicle_id, epoch_us(TIMESTAMP '2023-12-01'+to_days(CAST(production_day+days_until_sale AS INTEGER))) AS sale_us, epoch_us(TIMESTAMP '2023-12-01'+to_days(CAST(event_day AS INTEGER))) AS event_us, event_day-production_day-days_until_sale AS event_dss FROM vehicles")
def p13(f):
    return derive.vehicle_clock(f.vehicles, ORIGIN).select("vehicle_id", F.unix_micros("sale_date").alias("sale_us"), F.unix_micros("event_date").alias("event_us"), "event_dss")


@query("p14_shifted_event", "SELECT vehicle_id, epoch_us(event_date)-3*86400000000 AS us FROM event_dates")
def p14(f):
    return f.event_dates.select("vehicle_id", F.unix_micros(derive.shift_days(F.col("event_date"), -3)).alias("us"))


@query("p15_pre_event_rows", "SELECT vehicle_id, count(*) AS n FROM trips LEFT JOIN event_odo USING (vehicle_id) WHERE event_odo IS NULL OR odo_end<=event_odo GROUP BY 1")
def p15(f):
    return derive.pre_event(f.trips.join(f.event_odo.select("vehicle_id", "event_odo"), "vehicle_id", "left")).groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("p16_usable_event", "SELECT vehicle_id, coalesce(event_day>41 AND event_day<50,false) AS usable FROM vehicles")
def p16(f):
    return f.vehicles.select("vehicle_id", derive.usable_event(F.col("event_day"), 41, 50).alias("usable"))


CRITERIA = {"market": "market < 4", "balance": "acctbal > 0", "event": "event_day > 41 or cohort = 'healthy'"}


@query("p17_universe_report", "SELECT CASE WHEN NOT market<4 THEN 'market' WHEN NOT acctbal>0 THEN 'balance' WHEN NOT coalesce(event_day>41 OR cohort='healthy',false) THEN 'event' ELSE 'kept' END AS reason, count(*) AS n FROM vehicles GROUP BY 1")
def p17(f):
    return derive.select_universe(f.vehicles, {k: F.expr(v) for k, v in CRITERIA.items()})[1]


@query("p18_external_set", "SELECT market, count(*) AS n FROM vehicles WHERE market IN (1,2) AND vehicle_id NOT IN (SELECT vehicle_id FROM cuts) GROUP BY 1")
def p18(f):
    x = f.vehicles.filter(F.col("market").isin(1, 2)).join(f.cuts.select("vehicle_id"), "vehicle_id", "left_anti")
    return x.groupBy("market").agg(F.count("*").alias("n"))


@query("p19_contract_columns", "SELECT vehicle_id, cut_odo, score AS feat_level, round(km_after,4) AS aux_km_after, label FROM scores")
def p19(f):
    x = f.scores.select("label", F.round("km_after", 4).alias("aux_km_after"), F.col("score").alias("feat_level"), "vehicle_id", "cut_odo")
    return derive.contract_order(x, ["vehicle_id", "cut_odo"])


@query("p20_promoted_aux", "SELECT vehicle_id, cut_odo, round(km_after,4) AS feat_km_after FROM scores")
def p20(f):
    return derive.promote(f.scores.select("vehicle_id", "cut_odo", F.round("km_after", 4).alias("aux_km_after")), ["aux_km_after"])


@query("p21_evaluable_rows", "SELECT vehicle_id, count(*) AS n FROM scores WHERE event_observed=1 OR km_after>=1000 GROUP BY 1")
def p21(f):
    return f.scores.filter("event_observed = 1 or km_after >= 1000").groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("p22_membership_guards", "SELECT CASE WHEN vehicle_id%5=0 THEN 'test' ELSE 'dev' END AS side, count(*) AS n FROM vehicles GROUP BY 1")
def p22(f):
    side = f.vehicles.select("vehicle_id", F.when(F.col("vehicle_id") % 5 == 0, "test").otherwise("dev").alias("side"))
    joins.assert_disjoint(side.filter("side = 'dev'"), side.filter("side = 'test'"))
    joins.assert_subset(f.trips, f.vehicles)
    joins.assert_columns_absent(f.scores, ["cohort"])
    return side.groupBy("side").agg(F.count("*").alias("n"))


@query("p23_exploratory_derivations", f"SELECT vehicle_id, round(sum(trip_km),2) AS km, round(avg({MIN}),4) AS minutes, round(avg(abs(level_end-level_start)),4) AS amplitude, round(avg(level_end-level_start),4) AS delta FROM trips GROUP BY 1")
def p23(f):
    x = derive.trip_columns(f.trips)
    return x.groupBy("vehicle_id").agg(F.round(F.sum("trip_km"), 2).alias("km"), F.round(F.avg("minutes"), 4).alias("minutes"), F.round(F.avg("amplitude"), 4).alias("amplitude"), F.round(F.avg("level_delta"), 4).alias("delta"))


@query("p24_signal_enrichment", "SELECT event_id, cohort='failed' AS has_event, round(event_odo-odo_end,4) AS km_to_event, 'msg_'||message AS slug FROM trips JOIN vehicles USING (vehicle_id) LEFT JOIN event_odo USING (vehicle_id)")
def p24(f):
    x = joins.attach_static(f.trips, f.vehicles.select("vehicle_id", "cohort")).join(f.event_odo.select("vehicle_id", "event_odo"), "vehicle_id", "left")
    slug = F.create_map(*(F.lit(v) for m in derive.MESSAGES for v in (m, f"msg_{m}")))
    return x.select("event_id", (F.col("cohort") == "failed").alias("has_event"), F.round(F.col("event_odo") - F.col("odo_end"), 4).alias("km_to_event"), slug[F.col("message")].alias("slug"))


@query("p25_raw_variant", "SELECT vehicle_id, cut_odo, round(km_after,4) AS feat_raw_km FROM scores")
def p25(f):
    x = f.scores.select("vehicle_id", "cut_odo", F.col("score").alias("feat_norm"), F.round("km_after", 4).alias("aux_raw_km"))
    return derive.promote(x.drop("feat_norm"), ["aux_raw_km"])


BYT = "(PARTITION BY vehicle_id ORDER BY t_start, event_id)"


@query("w01_rest_time", f"SELECT event_id, round(r,6) AS rest_h, coalesce(r*3600<=3600,false) AS chained FROM (SELECT event_id, greatest(0.0::DOUBLE,(epoch_us(t_start)-epoch_us(p))/3600000000.0::DOUBLE) AS r0, CASE WHEN p IS NULL THEN NULL ELSE greatest(0.0::DOUBLE,(epoch_us(t_start)-epoch_us(p))/3600000000.0::DOUBLE) END AS r FROM (SELECT *, lag(t_end) OVER {BYT} AS p FROM trips))")
def w01(f):
    return derive.rest_times(f.trips).select("event_id", F.round("rest_h", 6).alias("rest_h"), "chained")


@query("w02_median_hours_between", f"SELECT vehicle_id, round(quantile_cont(h,0.5),6) AS median_h FROM (SELECT vehicle_id, (epoch_us(t_start)-epoch_us(lag(t_start) OVER {BYT}))/3600000000.0::DOUBLE AS h FROM trips) GROUP BY 1")
def w02(f):
    h = (F.unix_micros("t_start") - F.unix_micros(F.lag("t_start").over(derive.by_time()))) / 3600e6
    return f.trips.withColumn("h", h).groupBy("vehicle_id").agg(F.round(F.percentile("h", F.lit(0.5)), 6).alias("median_h"))


@query("w03_level_rise_and_drop", "SELECT event_id, CASE WHEN level_start IS NOT NULL THEN greatest(0.0::DOUBLE,level_end-level_start) END AS rise, CASE WHEN level_start IS NOT NULL THEN greatest(0.0::DOUBLE,level_start-level_end) END AS \"drop\" FROM trips")
def w03(f):
    return derive.level_changes(f.trips).select("event_id", "rise", "drop")


@query("w04_message_transitions", f"SELECT vehicle_id, count(*) FILTER (message='purchase') AS n_first, count(*) FILTER (message='purchase' AND nx='error') AS to_error, count(*) FILTER (message='purchase' AND nx='signup') AS to_signup FROM (SELECT *, lead(message) OVER {BYT} AS nx FROM trips) GROUP BY 1")
def w04(f):
    return derive.transitions_of_messages(f.trips, "purchase", ("error", "signup"))


MARKERS = f"""(SELECT vehicle_id, least(a,t_start) AS a, greatest(a,t_start) AS b, unnest(list_filter([CASE WHEN epoch_us(t_start)-epoch_us(a)>24*3600000000 THEN 'long_gap' END, CASE WHEN l0-level_end>=40 THEN 'drop_off_trip' END, CASE WHEN odo_end-o0>150 THEN 'odo_jump' END, CASE WHEN message='signup' THEN 'manual' END], lambda x: x IS NOT NULL)) AS marker
  FROM (SELECT *, lag(t_end) OVER {BYT} AS a, lag(level_end) OVER {BYT} AS l0, lag(odo_end) OVER {BYT} AS o0 FROM trips) WHERE a IS NOT NULL)"""


@query("w05_intervention_markers", f"SELECT vehicle_id, marker, count(*) AS n, epoch_us(min(a)) AS first_us, epoch_us(max(b)) AS last_us FROM {MARKERS} GROUP BY ALL")
def w05(f):
    x = derive.intervention_markers(f.trips)
    return x.groupBy("vehicle_id", "marker").agg(F.count("*").alias("n"), F.unix_micros(F.min("a")).alias("first_us"), F.unix_micros(F.max("b")).alias("last_us"))


@query("w06_largest_drop_near_event", "SELECT vehicle_id, d AS largest_drop, round(odo_end-event_odo,4) AS km_from_event FROM (SELECT t.vehicle_id, level_start-level_end AS d, odo_end, event_odo, row_number() OVER (PARTITION BY t.vehicle_id ORDER BY level_start-level_end DESC, event_id) AS k FROM trips t JOIN event_odo USING (vehicle_id) WHERE level_start>level_end AND abs(odo_end-event_odo)<=200) WHERE k=1")
def w06(f):
    x = derive.level_changes(f.trips).join(f.event_odo.select("vehicle_id", "event_odo"), "vehicle_id").filter("drop > 0 and abs(odo_end - event_odo) <= 200")
    return x.groupBy("vehicle_id").agg(F.min_by(F.struct("drop", "odo_end", "event_odo"), F.struct((-F.col("drop")).alias("d"), "event_id")).alias("r")).select("vehicle_id", F.col("r.drop").alias("largest_drop"), F.round(F.col("r.odo_end") - F.col("r.event_odo"), 4).alias("km_from_event"))


@query("w07_running_max", f"SELECT event_id, max(value) OVER (PARTITION BY vehicle_id ORDER BY t_start, event_id ROWS UNBOUNDED PRECEDING) AS top FROM trips")
def w07(f):
    from pyspark.sql import Window

    return f.trips.select("event_id", F.max("value").over(derive.by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("top"))


@query("u08_marker_union", f"SELECT vehicle_id, 'any' AS marker, count(*) AS n FROM {MARKERS} GROUP BY 1 UNION ALL SELECT vehicle_id, 'event', count(*) FROM event_dates GROUP BY 1")
def u08(f):
    m = derive.intervention_markers(f.trips).withColumn("marker", F.lit("any"))
    e = f.event_dates.select("vehicle_id", F.col("event_date").alias("a"), F.col("event_date").alias("b"), F.lit("event").alias("marker"))
    return m.unionByName(e).groupBy("vehicle_id", "marker").agg(F.count("*").alias("n"))
