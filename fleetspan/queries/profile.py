"""Queries of aggregations, sorts and scalar functions (A, T, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import derive, joins
from ..operators import profile as P
from ..operators.quantiles import quantiles
from ..sources.fleet import BIN_KM, ORIGIN
from .derive import BYT, MIN
from .registry import query


def _r(c, n=4):
    return F.round(c, n).alias(c)


def _rounded(df, n=4):
    return df.select(*(F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes))


def q(c, p):
    return f"quantile_cont({c},{p})"


def derived(f):
    return derive.trip_columns(f.trips)


def static_trips(f):
    return joins.attach_static(derived(f), f.vehicles)


def event_trips(f):
    """Derived trips with km_to_event."""
    return derive.enrich(derived(f), f.event_odo.select("vehicle_id", "event_odo"))


D = f"(SELECT *, {MIN} AS minutes, CASE WHEN trip_km>0 THEN trip_km/nullif(({MIN})/60,0) END AS kmh, level_end-level_start AS level_delta, abs(level_end-level_start) AS amplitude, CASE WHEN level_end<level_start THEN level_start-level_end END AS regen_drop, level_end>=95 AS saturated, CASE WHEN trip_km>=5 AND level_start>level_end THEN (level_start-level_end)/trip_km*100 END AS fuel_100km FROM trips)"


@query("a01_vehicle_aggregates", "SELECT user_id AS vehicle_id, count(*) AS n, round(sum(value),2) AS value, max(value) AS top, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1")
def a01(f):
    return f.trips.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.max("value").alias("top"), F.unix_micros(F.min("t_start")).alias("first_us"), F.unix_micros(F.max("t_start")).alias("last_us"), F.countDistinct("message").alias("n_types"))


@query("a02_quality", """SELECT unnest(['level_start','level_end','message']) AS "column", unnest(['double','double','string']) AS dtype, unnest([a,b,c]) AS n_null, unnest([round(a/n,6),round(b/n,6),round(c/n,6)]) AS null_share FROM (SELECT count(*)::DOUBLE AS n, count(*)-count(level_start) AS a, count(*)-count(level_end) AS b, count(*)-count(message) AS c FROM trips)""")
def a02(f):
    return P.quality(f.trips.select("level_start", "level_end", "message")).withColumn("null_share", F.round("null_share", 6))


A03 = f"""SELECT vehicle_id, count(*) AS n_trips, round(sum(trip_km),2) AS km, count(*) FILTER (trip_km<=0) AS n_idle, count(*) FILTER (trip_km>0) AS n_moving, count(*) FILTER (trip_km>0 AND trip_km<20) AS n_short, round(avg(minutes),4) AS minutes_mean, round(quantile_cont(minutes,0.9),4) AS minutes_p90,
  count(*) FILTER (trip_km>0 AND kmh<=30) AS n_urban, count(*) FILTER (level_start<20) AS n_cold, round(quantile_cont(minutes,0.5),4) AS minutes_p50, round(quantile_cont(level_end,0.5),4) AS level_p50, round(quantile_cont(level_end,0.9),4) AS level_p90, min(level_end) AS level_min, max(level_end) AS level_max,
  count(*) FILTER (message='error') AS n_abnormal, round(count(*) FILTER (message='error')*1000.0::DOUBLE/nullif(sum(trip_km),0)+1e-9,4) AS abnormal_per_1000km, count(*) FILTER (message='purchase') AS n_cleaning, round(count(*) FILTER (message='purchase')*1000.0::DOUBLE/nullif(sum(trip_km),0)+1e-9,4) AS cleaning_per_1000km,
  round(count(regen_drop)*1000.0::DOUBLE/nullif(sum(trip_km),0)+1e-9,4) AS drops_per_1000km, round(avg(fuel_100km)+1e-9,4) AS fuel_mean, round(count(*)/greatest((epoch_us(max(t_end))-epoch_us(min(t_start)))/86400000000.0::DOUBLE,1.0)+1e-9,4) AS trips_per_day,
  round(avg(kmh),4) AS kmh_mean, round(max(kmh),4) AS kmh_max, round(avg(level_end),4) AS level_mean, round(quantile_cont(level_end,0.1),4) AS level_p10, round(stddev_samp(level_end),4) AS level_sd, count(*) FILTER (saturated) AS n_saturated, round(count(*) FILTER (saturated)*1000.0::DOUBLE/nullif(sum(trip_km),0),4) AS saturated_per_1000km,
  round(avg(regen_drop),4) AS drop_mean, count(regen_drop) AS n_drops, round(quantile_cont(fuel_100km,0.5),4) AS fuel_p50, round(avg(amplitude),4) AS amplitude_mean, min(odo_end) AS odo_first, max(odo_end) AS odo_last,
  round(greatest((epoch_us(max(t_end))-epoch_us(min(t_start)))/86400000000.0::DOUBLE,1.0),4) AS days, round(sum(trip_km)/greatest((epoch_us(max(t_end))-epoch_us(min(t_start)))/86400000000.0::DOUBLE,1.0),4) AS km_per_day FROM {D} GROUP BY 1"""


@query("a03_trip_aggregates", A03)
def a03(f):
    x = P.trip_aggregates(derived(f))
    safe = ("abnormal_per_1000km", "cleaning_per_1000km", "drops_per_1000km", "fuel_mean", "trips_per_day")
    return _rounded(x.withColumns({c: F.col(c) + 1e-9 for c in safe}))


@query("a04_signal_aggregates", "SELECT vehicle_id, count(*) AS n, round(avg(level_end),4) AS level_mean, round(quantile_cont(level_end,0.5),4) AS level_p50, max(odo_end) AS last_odo FROM trips WHERE message='error' GROUP BY 1")
def a04(f):
    return _rounded(f.trips.filter("message = 'error'").groupBy("vehicle_id").agg(F.count("*").alias("n"), F.avg("level_end").alias("level_mean"), F.percentile("level_end", F.lit(0.5)).alias("level_p50"), F.max("odo_end").alias("last_odo")))


@query("a05_slope", "SELECT vehicle_id, round(regr_slope(level_end,odo_end)*1000,4) AS slope FROM trips GROUP BY 1")
def a05(f):
    return f.trips.groupBy("vehicle_id").agg(F.round(P.slope_per_1000km("level_end"), 4).alias("slope"))


@query("a06_message_counts", "SELECT vehicle_id, message, count(*) AS n FROM trips GROUP BY ALL")
def a06(f):
    return f.trips.groupBy("vehicle_id", "message").agg(F.count("*").alias("n"))


@query("a07_scoped_severity", "SELECT t.vehicle_id, scope, count(*) AS n, count(*) FILTER (message='error') AS n_flag, round(count(*) FILTER (message='error')*1000.0::DOUBLE/nullif(sum(trip_km),0),4) AS per_1000km FROM trips t JOIN (SELECT vehicle_id, max(odo_end) AS top, unnest([1.0::DOUBLE,0.8::DOUBLE,0.7::DOUBLE]) AS scope FROM trips GROUP BY 1) m ON m.vehicle_id=t.vehicle_id AND odo_end<=scope*top GROUP BY ALL")
def a07(f):
    return P.scoped_rates(f.trips, F.col("message") == "error").withColumn("per_1000km", F.round("per_1000km", 4))


@query("a08_exact_quantiles", " UNION ALL ".join(f"SELECT cohort, '{m}' AS metric, count({m}) AS n, round({q(m, 0.1)},4) AS p10, round({q(m, 0.5)},4) AS p50, round({q(m, 0.99)},4) AS p99 FROM trips JOIN vehicles USING (vehicle_id) GROUP BY 1" for m in ("value", "level_end", "level_start")))
def a08(f):
    return _rounded(P.exact_quantiles(joins.attach_static(f.trips, f.vehicles), ["cohort"], ["value", "level_end", "level_start"], (0.1, 0.5, 0.99)))


@query("a09_exact_histogram", "SELECT cohort, bin, n, round(n/sum(n) OVER (PARTITION BY cohort)::DOUBLE,6) AS share FROM (SELECT cohort, CAST(greatest(0,least(9,floor((value-10)/14))) AS INTEGER) AS bin, count(*) AS n FROM trips JOIN vehicles USING (vehicle_id) GROUP BY ALL)")
def a09(f):
    return P.histogram(joins.attach_static(f.trips, f.vehicles), ["cohort"], "value", 10, 150, 10).withColumn("share", F.round("share", 6))


@query("a10_daily_activity", "SELECT CAST(date_trunc('day',t_start)::DATE AS VARCHAR) AS d, count(*) AS n_trips, count(DISTINCT vehicle_id) AS n_vehicles, round(sum(trip_km),2) AS km, CAST(dayofweek(min(t_start))+1 AS INTEGER) AS weekday, strftime(min(t_start),'%Y-%m') AS month FROM trips GROUP BY 1")
def a10(f):
    return P.daily_activity(f.trips).select(F.col("d").cast("string").alias("d"), "n_trips", "n_vehicles", _r("km", 2), "weekday", "month")


@query("a11_usability_and_bands", "SELECT market, count(*) FILTER (event_day>41) AS usable, count(*) AS n, count(*) FILTER (production_day<5 AND cohort='failed') AS early_failed, count(*) FILTER (production_day<5 AND cohort='healthy') AS early_healthy FROM vehicles GROUP BY 1")
def a11(f):
    x = f.vehicles
    a = x.groupBy("market").agg(F.count_if(derive.usable_event(F.col("event_day"), 41, 10**6)).alias("usable"), F.count("*").alias("n"))
    b = P.crosstab(x.filter("production_day < 5"), "market", "cohort", ["failed", "healthy"]).withColumnsRenamed({"failed": "early_failed", "healthy": "early_healthy"})
    return a.join(b, "market")


@query("a12_origin_estimate", "SELECT cohort, count(*) AS n, quantile_cont(o,0.5) AS median, round(stddev_samp(o),4) AS sd, quantile_cont(o,0.75)-quantile_cont(o,0.25) AS iqr, min(o) AS lo, max(o) AS hi FROM (SELECT vehicle_id, cohort, CAST(floor(epoch_us(min(t_start))/86400000000)-production_day AS BIGINT) AS o FROM trips JOIN vehicles USING (vehicle_id) GROUP BY vehicle_id, cohort, production_day) GROUP BY 1")
def a12(f):
    return P.origin_estimate(f.trips, f.vehicles, ["cohort"]).withColumn("sd", F.round("sd", 4))


BIN = f"CAST(greatest(ceil(odo_end/{BIN_KM})-1,0) AS BIGINT)"


@query("a13_channel_bins", f"SELECT vehicle_id, {BIN} AS bin, round(avg(level_end),4) AS mean, max(level_end) AS top, count(*) AS n, round(sum(trip_km),2) AS km, max(CASE WHEN message='error' THEN 1 ELSE 0 END) AS any_error FROM trips GROUP BY ALL")
def a13(f):
    from ..plans import panes

    specs = [("mean", "level_end", "mean"), ("top", "level_end", "max"), ("n", "*", "count"), ("km", "trip_km", "sum"), ("any_error", "cast(message = 'error' as int)", "any")]
    return panes.channels(f.trips, BIN_KM, specs).withColumns({"mean": F.round("mean", 4), "km": F.round("km", 2)})


@query("a14_weighted_cells", "SELECT vehicle_id, strftime(t_start,'%W') AS week, CASE WHEN sum(trip_km)>=300 THEN round(sum(level_end)/sum(trip_km),6) END AS value, round(sum(trip_km),2) AS weight FROM trips WHERE trip_km>0 GROUP BY ALL")
def a14(f):
    # week of the year from its first Monday on, as %W
    x = f.trips.filter("trip_km > 0").withColumn("week", F.lpad(F.floor((F.dayofyear("t_start") + 6 - (F.weekday("t_start"))) / 7).cast("string"), 2, "0"))
    return P.weighted_cells(x, ["vehicle_id", "week"], "level_end", "trip_km", 300).select("vehicle_id", "week", _r("value", 6), _r("weight", 2))


@query("a15_km_series_bins", f"SELECT coalesce(a.vehicle_id,b.vehicle_id) AS vehicle_id, coalesce(a.bin,b.bin) AS bin, a.level, b.n_bad FROM (SELECT vehicle_id, {BIN} AS bin, round(avg(level_end),4) AS level FROM trips WHERE trip_km>0 GROUP BY ALL) a FULL JOIN (SELECT vehicle_id, {BIN} AS bin, count(*) AS n_bad FROM trips WHERE message='error' GROUP BY ALL) b ON a.vehicle_id=b.vehicle_id AND a.bin=b.bin")
def a15(f):
    from ..plans import panel

    a = panel.bins(f.trips.filter("trip_km > 0"), BIN_KM, [F.round(F.avg("level_end"), 4).alias("level")])
    b = panel.bins(f.trips.filter("message = 'error'"), BIN_KM, [F.count("*").alias("n_bad")])
    return a.join(b, ["vehicle_id", "bin"], "full_outer").select("vehicle_id", "bin", "level", "n_bad")


@query("a16_composition", "SELECT market, engine, count(*) FILTER (cohort='failed') AS failed, count(*) FILTER (cohort='healthy') AS healthy FROM vehicles GROUP BY ALL")
def a16(f):
    return f.vehicles.groupBy("market", "engine").pivot("cohort", ["failed", "healthy"]).agg(F.count(F.lit(1))).fillna(0)


PD = "(SELECT vehicle_id, market, cohort, event_day, unnest(generate_series(DATE '2024-01-05' + CAST(production_day AS INTEGER), DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS day, DATE '2024-01-05' + CAST(production_day AS INTEGER) AS d0, (TIMESTAMP '2023-12-01'+to_days(CAST(event_day AS INTEGER)))::DATE AS ed FROM vehicles)"


def exposure(f):
    clock = derive.vehicle_clock(f.vehicles, ORIGIN)
    x = clock.select("vehicle_id", "market", "cohort", F.date_add(F.lit("2024-01-05").cast("date"), F.col("production_day").cast("int")).alias("d0"), F.lit("2024-01-25").cast("date").alias("d1"), F.to_date("event_date").alias("ed"))
    return P.person_days(x, "d0", "d1", "ed")


@query("a17_person_time_rates", f"SELECT market, count(*) AS days, CAST(sum(CASE WHEN day=ed THEN 1 ELSE 0 END) AS BIGINT) AS events, round(sum(CASE WHEN day=ed THEN 1 ELSE 0 END)/(count(*)/30.4375::DOUBLE)*100,6) AS per_100_vehicle_months FROM {PD} GROUP BY 1")
def a17(f):
    e = F.sum("is_event")
    return exposure(f).groupBy("market").agg(F.count("*").alias("days"), e.alias("events"), F.round(e / (F.count("*") / 30.4375) * 100, 6).alias("per_100_vehicle_months"))


@query("a18_expected_vs_observed", f"""WITH p AS (SELECT *, (day-d0)//3 AS bin, CASE WHEN day=ed THEN 1 ELSE 0 END AS e, CASE WHEN vehicle_id%2=0 THEN 'ref' ELSE 'w'||(vehicle_id%4) END AS win FROM {PD}), h AS (SELECT bin, sum(e)/count(*)::DOUBLE AS h FROM p WHERE win='ref' GROUP BY 1)
  SELECT win AS "window", round(sum(n*coalesce(h,0)),6) AS expected, CAST(sum(e) AS BIGINT) AS observed FROM (SELECT win, bin, count(*) AS n, sum(e) AS e FROM p WHERE win<>'ref' GROUP BY ALL) LEFT JOIN h USING (bin) GROUP BY 1""")
def a18(f):
    x = exposure(f)
    other = x.filter("vehicle_id % 2 = 1").withColumn("window", F.concat(F.lit("w"), (F.col("vehicle_id") % 4).cast("string")))
    return P.expected_events(x.filter("vehicle_id % 2 = 0"), other, 3).withColumn("expected", F.round("expected", 6))


@query("a19_monthly_registration", "SELECT day AS period, count(*) FILTER (message='error') AS error, count(*) FILTER (message='purchase') AS purchase, count(DISTINCT vehicle_id) AS active, round(sum(trip_km),2) AS km, round(count(*) FILTER (message='error')*1000.0::DOUBLE/sum(trip_km),4) AS error_per_1000km FROM (SELECT *, strftime(t_start,'%Y-%m-%d') AS day FROM trips) GROUP BY 1")
def a19(f):
    d = F.date_format("t_start", "yyyy-MM-dd").alias("period")
    a = f.trips.filter(F.col("message").isin("error", "purchase")).groupBy(d).pivot("message", ["error", "purchase"]).agg(F.count(F.lit(1))).fillna(0)
    b = f.trips.groupBy(d).agg(F.countDistinct("vehicle_id").alias("active"), F.sum("trip_km").alias("km"))
    return a.join(b, "period", "full_outer").select("period", F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("purchase", F.lit(0)).alias("purchase"), "active", _r("km", 2), F.round(F.col("error") * 1000 / F.col("km"), 4).alias("error_per_1000km"))


@query("a20_recency_and_shares", "SELECT cohort, count(*) AS n, round(quantile_cont(h,0.5),4) AS median_h, round(count(*)/sum(count(*)) OVER ()::DOUBLE,6) AS share FROM (SELECT vehicle_id, cohort, (epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(t_start)))/3600000000.0::DOUBLE AS h FROM trips JOIN vehicles USING (vehicle_id) WHERE message='signup' GROUP BY ALL) GROUP BY 1")
def a20(f):
    x = joins.attach_static(f.trips.filter("message = 'signup'"), f.vehicles).groupBy("vehicle_id", "cohort").agg(F.max(F.unix_micros("t_start")).alias("last"))
    h = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.col("last")) / 3600e6
    g = quantiles(x, ["cohort"], [("median_h", h, 0.5)], [F.count("*").alias("n")]).withColumn("median_h", F.round("median_h", 4))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per cohort


@query("a21_data_checks", f"SELECT vehicle_id, count(*) FILTER (event_id<=pe) AS id_back, count(*) FILTER (odo_end<po) AS odo_back, count(*) FILTER (trip_km<=0) AS no_speed, count(*) FILTER (epoch_us(t_start)-epoch_us(pt)>86400000000) AS gaps, round(corr(value,level_end),4) AS corr FROM (SELECT *, lag(event_id) OVER {BYT} AS pe, lag(odo_end) OVER {BYT} AS po, lag(t_start) OVER {BYT} AS pt FROM trips) GROUP BY 1")
def a21(f):
    x = f.trips.withColumns({"pe": F.lag("event_id").over(derive.by_time()), "po": F.lag("odo_end").over(derive.by_time()), "pt": F.lag("t_start").over(derive.by_time())})
    return x.groupBy("vehicle_id").agg(F.count_if(F.col("event_id") <= F.col("pe")).alias("id_back"), F.count_if(F.col("odo_end") < F.col("po")).alias("odo_back"), F.count_if(F.col("trip_km") <= 0).alias("no_speed"), F.count_if(F.unix_micros("t_start") - F.unix_micros("pt") > 86_400_000_000).alias("gaps"), F.round(F.corr("value", "level_end"), 4).alias("corr"))


@query("a22_marker_completeness", "SELECT vehicle_id, round(max(odo_end) FILTER (message='signup')/nullif(max(odo_end),0),6) AS last_marker, round(max(odo_end) FILTER (level_end<level_start)/nullif(max(odo_end),0),6) AS last_drop FROM trips GROUP BY 1")
def a22(f):
    top = F.nullif(F.max("odo_end"), F.lit(0.0))
    return f.trips.groupBy("vehicle_id").agg(F.round(F.max(F.when(F.col("message") == "signup", F.col("odo_end"))) / top, 6).alias("last_marker"), F.round(F.max(F.when(F.col("level_end") < F.col("level_start"), F.col("odo_end"))) / top, 6).alias("last_drop"))


@query("a23_extra_aggregates", "SELECT vehicle_id, round(count(*) FILTER (level_start-level_end>0 AND level_start-level_end<20)/nullif(count(*) FILTER (level_end<level_start),0)::DOUBLE,6) AS interrupted_share, round(avg(level_start-level_end) FILTER (level_end<level_start),4) AS drop_size FROM trips GROUP BY 1")
def a23(f):
    d = F.col("level_start") - F.col("level_end")
    return f.trips.groupBy("vehicle_id").agg(F.round(F.try_divide(F.count_if((d > 0) & (d < 20)), F.count_if(d > 0)), 6).alias("interrupted_share"), F.round(F.avg(F.when(d > 0, d)), 4).alias("drop_size"))


@query("a24_vehicle_bins", "SELECT vehicle_id, floor(odo_end/500.0)*500.0::DOUBLE AS bin, count(*) AS n, round(avg(level_end),4) AS value, round(sum(trip_km),2) AS km FROM trips GROUP BY ALL HAVING count(*)>=5")
def a24(f):
    x = P.binned(f.trips, F.col("level_end"), 500.0, 5)
    return x.select("vehicle_id", "bin", "n", _r("value"), _r("km", 2))


@query("a25_event_aligned_profile", "SELECT bin, count(*) AS n_vehicles, round(quantile_cont(v,0.5),4) AS median FROM (SELECT vehicle_id, floor((event_odo-odo_end)/200)*200.0::DOUBLE AS bin, avg(level_end) AS v FROM trips JOIN event_odo USING (vehicle_id) GROUP BY ALL) GROUP BY 1 HAVING count(*)>=10")
def a25(f):
    return P.aligned_profile(event_trips(f), 200.0, "level_end", 10).withColumn("median", F.round("median", 4))


@query("a26_pre_post_change", " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n_vehicles, round(quantile_cont(a-b,0.5),4) AS median_delta, round(avg(CASE WHEN a-b<0 THEN 1.0::DOUBLE ELSE 0 END),6) AS share_decreasing FROM (SELECT vehicle_id, avg({m}) FILTER (odo_end<=event_odo) AS b, avg({m}) FILTER (odo_end>event_odo) AS a FROM trips JOIN event_odo USING (vehicle_id) GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL" for m in ("level_end", "value")))
def a26(f):
    x = f.trips.join(f.event_odo.select("vehicle_id", "event_odo"), "vehicle_id")
    return P.paired_change(x, F.col("odo_end") > F.col("event_odo"), ["level_end", "value"]).select("metric", "n_vehicles", _r("median_delta"), _r("share_decreasing", 6))


@query("a27_within_vehicle_stability", " UNION ALL ".join(f"""SELECT '{m}' AS metric, count(*) AS n_vehicles, round((any_value(msb)-any_value(msw))/(any_value(msb)+(any_value(n0)-1)*any_value(msw)),4) AS icc, round(quantile_cont(sqrt(v)/nullif(abs(m),0),0.5),4) AS median_cv FROM (SELECT *, (sum(n*m*m) OVER () - pow(sum(n*m) OVER (),2)/sum(n) OVER ())/(count(*) OVER ()-1) AS msb, sum((n-1)*v) OVER ()/(sum(n) OVER ()-count(*) OVER ()) AS msw, (sum(n) OVER ()-sum(n*n) OVER ()/(sum(n) OVER ())::DOUBLE)/(count(*) OVER ()-1) AS n0 FROM (SELECT vehicle_id, count(*) AS n, avg({m}) AS m, var_samp({m}) AS v FROM trips WHERE {m} IS NOT NULL GROUP BY 1 HAVING count(*)>=2))""" for m in ("value", "level_end")))
def a27(f):
    return _rounded(P.stability(f.trips, ["value", "level_end"]))


@query("a28_around_reference_day", "SELECT CAST(rel AS BIGINT) AS rel, coalesce(n,0) AS n, mean FROM (SELECT unnest(generate_series(-10,10)) AS rel) LEFT JOIN (SELECT CAST(floor((epoch_us(t_start)-epoch_us(event_date))/86400000000) AS BIGINT) AS rel, count(*) AS n, round(avg(level_end),4) AS mean FROM trips JOIN event_dates USING (vehicle_id) GROUP BY 1) USING (rel)")
def a28(f):
    return P.around_day(f.trips, f.event_dates.withColumnRenamed("event_date", "at"), 10, "level_end").select("rel", "n", _r("mean"))


@query("a29_funnel_with_totals", "SELECT coalesce(CAST(market AS VARCHAR),'all') AS market, cohort, count(*) AS n, count(*) FILTER (acctbal>0) AS n_ok FROM vehicles GROUP BY GROUPING SETS ((market,cohort),(cohort))")
def a29(f):
    x = f.vehicles.groupingSets([[F.col("market"), F.col("cohort")], [F.col("cohort")]], "market", "cohort").agg(F.count("*").alias("n"), F.count_if(F.col("acctbal") > 0).alias("n_ok"))
    return x.select(F.coalesce(F.col("market").cast("string"), F.lit("all")).alias("market"), "cohort", "n", "n_ok")


@query("a30_date_percentiles", "SELECT market, round(quantile_cont(d,0.1),4) AS p10, quantile_cont(d,0.5) AS p50 FROM (SELECT market, CAST(production_day+days_until_sale AS DOUBLE) AS d FROM vehicles) GROUP BY 1")
def a30(f):
    d = F.unix_date(F.to_date("sale_date")) - F.unix_date(F.lit(ORIGIN).cast("date"))
    return quantiles(derive.vehicle_clock(f.vehicles, ORIGIN), ["market"], [("p10", d, 0.1), ("p50", d, 0.5)]).withColumn("p10", F.round("p10", 4))


@query("a31_healthy_reference_curve", "SELECT bin, count(*) AS n, round(quantile_cont(v,0.25),4) AS q1, round(quantile_cont(v,0.5),4) AS median, round(quantile_cont(v,0.75),4) AS q3 FROM (SELECT vehicle_id, floor(odo_end/500.0)*500.0::DOUBLE AS bin, avg(level_end) AS v FROM trips JOIN vehicles USING (vehicle_id) WHERE cohort='healthy' GROUP BY ALL) GROUP BY 1 HAVING count(*)>=5")
def a31(f):
    x = P.binned(joins.attach_static(f.trips, f.vehicles).filter("cohort = 'healthy'"), F.col("level_end"), 500.0, 1)
    x = x.withColumnRenamed("n", "rows")
    q = quantiles(x, ["bin"], [("q1", "value", 0.25), ("median", "value", 0.5), ("q3", "value", 0.75)], [F.count("*").alias("n")]).filter("n >= 5")
    return q.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("a32_split_balance", " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS value, count(*) FILTER (vehicle_id%5<>0) AS n_dev, count(*) FILTER (vehicle_id%5=0) AS n_test, round(count(*) FILTER (vehicle_id%5=0)/count(*)::DOUBLE,6) AS test_share FROM vehicles GROUP BY 2" for v in ("market", "engine", "cohort")))
def a32(f):
    x = f.vehicles.select((F.col("vehicle_id") % 5 == 0).alias("t"), *(F.col(c).cast("string").alias(c) for c in ("market", "engine", "cohort"))).unpivot(["t"], ["market", "engine", "cohort"], "variable", "value")
    return x.groupBy("variable", "value").agg(F.count_if(~F.col("t")).alias("n_dev"), F.count_if("t").alias("n_test"), F.round(F.avg(F.col("t").cast("double")), 6).alias("test_share"))


@query("a33_at_risk_funnel", "SELECT count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, count(*) FILTER (event_observed=1) AS event_rows, round(sum(km_after),2) AS exposure_km FROM cuts")
def a33(f):
    return f.cuts.agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), F.count_if(F.col("event_observed") == 1).alias("event_rows"), F.round(F.sum("km_after"), 2).alias("exposure_km"))


A34 = "SELECT '{0}' AS scale, count(*) AS n, round(stddev_samp(ln({0})),6) AS sd_log, round(stddev_samp({0})/avg({0}),6) AS cv, round((quantile_cont({0},0.75)-quantile_cont({0},0.25))/(quantile_cont({0},0.75)+quantile_cont({0},0.25)),6) AS qcd FROM (SELECT event_odo, CAST(event_day AS DOUBLE) AS event_day FROM event_odo JOIN vehicles USING (vehicle_id)) WHERE {0}>0"


@query("a34_event_time_dispersion", " UNION ALL ".join(A34.format(s) for s in ("event_odo", "event_day")))
def a34(f):
    return _rounded(P.dispersion(f.event_odo.join(f.vehicles, "vehicle_id").select("event_odo", "event_day"), ["event_odo", "event_day"]), 6)


@query("a35_early_dose", "WITH x AS (SELECT vehicle_id, sum(trip_km) AS dose, CAST(any_value(event_day) AS DOUBLE) AS e FROM trips JOIN vehicles USING (vehicle_id) WHERE event_day IS NOT NULL AND t_start<TIMESTAMP '2024-01-08' GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY dose)+(count(*) OVER (PARTITION BY dose)-1)/2.0::DOUBLE AS a, rank() OVER (ORDER BY e)+(count(*) OVER (PARTITION BY e)-1)/2.0::DOUBLE AS b FROM x) SELECT count(*) AS n, round(corr(a,b),6) AS rho FROM r")
def a35(f):
    x = joins.attach_static(f.trips, f.vehicles).filter("event_day is not null and t_start < timestamp'2024-01-08'").groupBy("vehicle_id").agg((F.sum("km_c") / 100.0).alias("dose"), F.first("event_day").cast("double").alias("e"))
    return P.ranked_corr(x, "dose", "e").withColumn("rho", F.round("rho", 6))


@query("a36_registry_window_table", f"SELECT strftime(day,'%Y-%m-%d') AS day, count(DISTINCT vehicle_id) AS at_risk, CAST(sum(CASE WHEN day=ed THEN 1 ELSE 0 END) AS BIGINT) AS events FROM {PD} WHERE ed IS NULL OR ed>=day GROUP BY 1")
def a36(f):
    return exposure(f).filter("ed is null or ed >= day").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("at_risk"), F.sum("is_event").alias("events"))


@query("a37_horizon_coverage", "SELECT round(avg(CASE WHEN km_after>=900 THEN 1.0::DOUBLE ELSE 0 END),6) AS full_share, round(avg(CASE WHEN label=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS label_share FROM cuts")
def a37(f):
    return f.cuts.agg(F.round(F.avg((F.col("km_after") >= 900).cast("double")), 6).alias("full_share"), F.round(F.avg("label"), 6).alias("label_share"))


@query("a38_feasibility_grid", "SELECT w AS window_km, h AS horizon_km, CAST(sum(greatest(0, floor((coalesce(event_odo-100,last_odo-100-h)+1e-6)/100)-ceil((first_odo+w)/100)+1)) AS BIGINT) AS n_cuts, count(*) FILTER (floor((coalesce(event_odo-100,last_odo-100-h)+1e-6)/100)>=ceil((first_odo+w)/100)) AS n_vehicles FROM (SELECT f.*, event_odo FROM (SELECT vehicle_id, min(odo_end) AS first_odo, max(odo_end) AS last_odo FROM trips GROUP BY 1) f LEFT JOIN event_odo USING (vehicle_id)) CROSS JOIN (SELECT unnest([200.0::DOUBLE,400.0::DOUBLE,800.0::DOUBLE]) AS w) CROSS JOIN (SELECT unnest([400.0::DOUBLE,800.0::DOUBLE]) AS h) GROUP BY ALL")
def a38(f):
    v = f.trips.groupBy("vehicle_id").agg(F.min("odo_end").alias("first_odo"), F.max("odo_end").alias("last_odo")).join(f.event_odo.select("vehicle_id", "event_odo"), "vehicle_id", "left")
    x = v.crossJoin(P.grid(f.spark, window_km=(200, 400, 800), horizon_km=(400, 800)))  # six rows
    n = F.floor((F.coalesce(F.col("event_odo") - 100, F.col("last_odo") - 100 - F.col("horizon_km")) + 1e-6) / 100) - F.ceil((F.col("first_odo") + F.col("window_km")) / 100) + 1
    return x.groupBy("window_km", "horizon_km").agg(F.sum(F.greatest(F.lit(0), n)).cast("bigint").alias("n_cuts"), F.count_if(n > 0).alias("n_vehicles"))


def shape_sql(metrics, rows):
    skew = "avg(pow({0}-{1},3))/nullif(pow(avg(pow({0}-{1},2)),1.5),0)"
    one = f"""SELECT metric, count(*) AS n, round({skew.format('v', 'm')}+1e-9,4)+0.0 AS skew, round(quantile_cont(v,0.99)/nullif(quantile_cont(v,0.5),0)+1e-9,4) AS tail, round(avg(z)+1e-9,4) AS zero_share, round({skew.format('lv', 'lm')}+1e-9,4)+0.0 AS skew_log,
      CASE WHEN avg(z)>0.5 THEN 'indicator' WHEN {skew.format('v', 'm')}>1 AND abs({skew.format('lv', 'lm')})<abs({skew.format('v', 'm')}) THEN 'log1p' ELSE 'none' END AS suggest
      FROM (SELECT metric, v, lv, avg(v) OVER (PARTITION BY metric) AS m, avg(lv) OVER (PARTITION BY metric) AS lm, CASE WHEN v=0 THEN 1.0::DOUBLE ELSE 0 END AS z FROM (SELECT metric, v, ln(1+greatest(v,0.0::DOUBLE)) AS lv FROM x WHERE v IS NOT NULL)) GROUP BY 1"""
    return "WITH x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM {rows}" for m in metrics) + ") " + one


@query("a39_distribution_shape", shape_sql(["value", "level_end", "regen_drop", "trip_km"], D))
def a39(f):
    x = P.shape(derived(f), ["value", "level_end", "regen_drop", "trip_km"])
    return _rounded(x.withColumns({c: F.col(c) + 1e-9 for c in ("skew", "tail", "zero_share", "skew_log")}))


@query("a39b_shape_moments", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(quantile_cont({m},0.99)/nullif(quantile_cont({m},0.5),0),4) AS tail, round(avg(CASE WHEN {m}=0 THEN 1.0::DOUBLE ELSE 0 END),6) AS zero_share FROM trips WHERE {m} IS NOT NULL" for m in ("value", "level_end")))
def a39b(f):
    return P.shape(f.trips, ["value", "level_end"]).select("metric", "n", _r("tail"), _r("zero_share", 6))


@query("a40_event_rate_by_static_bin", "SELECT CAST(greatest(0,least(4,floor((acctbal+1000)/2200))) AS INTEGER) AS bin, count(*) AS n, round(avg(CASE WHEN cohort='failed' THEN 1.0::DOUBLE ELSE 0 END),6) AS rate FROM vehicles GROUP BY 1")
def a40(f):
    b = F.greatest(F.lit(0), F.least(F.lit(4), F.floor((F.col("acctbal") + 1000) / 2200))).cast("int")
    return f.vehicles.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("cohort") == "failed").cast("double")), 6).alias("rate"))


TREND = "(SELECT vehicle_id, cohort, bin, avg(level_end) AS v FROM (SELECT vehicle_id, cohort, floor(odo_end/250.0) AS bin, level_end FROM trips JOIN vehicles USING (vehicle_id)) GROUP BY ALL)"


def trends(f):
    x = joins.attach_static(f.trips, f.vehicles).groupBy("vehicle_id", "cohort", F.floor(F.col("odo_end") / 250.0).alias("bin")).agg(F.avg("level_end").alias("v"))
    # a vehicle's bins are few, so they are ranked in place
    w = Window.partitionBy("vehicle_id").orderBy("v")
    x = x.withColumns({"rv": F.rank().over(w) + (F.count("*").over(Window.partitionBy("vehicle_id", "v")) - 1) / 2.0, "rb": F.rank().over(Window.partitionBy("vehicle_id").orderBy("bin")).cast("double")})
    return x.groupBy("vehicle_id", "cohort").agg(F.count("*").alias("n"), F.corr("rv", "rb").alias("rho"), F.regr_slope("v", "bin").alias("slope")).filter("n >= 3")


@query("a41_vehicle_trends", f"SELECT vehicle_id, count(*) AS n, round(corr(rv,rb),4)+0.0::DOUBLE AS rho, round(regr_slope(v,bin),4)+0.0::DOUBLE AS slope FROM (SELECT *, rank() OVER (PARTITION BY vehicle_id ORDER BY v)+(count(*) OVER (PARTITION BY vehicle_id,v)-1)/2.0::DOUBLE AS rv, rank() OVER (PARTITION BY vehicle_id ORDER BY bin)::DOUBLE AS rb FROM {TREND}) GROUP BY 1 HAVING count(*)>=3")
def a41(f):
    return trends(f).select("vehicle_id", "n", (F.round("rho", 4) + 0.0).alias("rho"), (F.round("slope", 4) + 0.0).alias("slope"))


@query("a42_monotonicity_summary", f"""WITH t AS (SELECT vehicle_id, any_value(cohort) AS cohort, round(corr(rv,rb),6) AS rho FROM (SELECT *, rank() OVER (PARTITION BY vehicle_id ORDER BY v)+(count(*) OVER (PARTITION BY vehicle_id,v)-1)/2.0::DOUBLE AS rv, rank() OVER (PARTITION BY vehicle_id ORDER BY bin)::DOUBLE AS rb FROM {TREND}) GROUP BY 1 HAVING count(*)>=3),
  r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY abs(rho))+(count(*) OVER (PARTITION BY cohort,abs(rho))-1)/2.0::DOUBLE AS rk FROM t WHERE rho IS NOT NULL AND NOT isnan(rho) AND rho<>0)
  SELECT cohort, count(*) AS n, round(quantile_cont(rho,0.5),4) AS median_rho, round(avg(CASE WHEN rho>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS share_up, sum(CASE WHEN rho>0 THEN rk ELSE 0 END) AS w_plus, CASE WHEN avg(CASE WHEN rho>0 THEN 1.0::DOUBLE ELSE 0 END)>=0.75 THEN 'rising' WHEN avg(CASE WHEN rho>0 THEN 1.0::DOUBLE ELSE 0 END)<=0.25 THEN 'falling' ELSE 'none' END AS verdict FROM r GROUP BY 1""")
def a42(f):
    x = P.monotone_summary(trends(f).withColumn("rho", F.round("rho", 6)), "rho", "cohort")
    return x.select("cohort", "n", _r("median_rho"), _r("share_up", 6), "w_plus", "verdict")


@query("a43_km_per_day", "SELECT vehicle_id, round(regr_slope(cut_odo, us/86400000000.0::DOUBLE),4) AS km_per_day FROM (SELECT vehicle_id, cut_odo, epoch_us(max(t_start)) AS us FROM win GROUP BY ALL) GROUP BY 1 HAVING count(DISTINCT us)>=3")
def a43(f):
    x = f.windowed.groupBy("vehicle_id", "cut_odo").agg(F.max(F.unix_micros("t_start")).alias("us"))
    # days from the vehicle's first cut, so that the slope isn't lost to rounding
    return x.groupBy("vehicle_id").agg(F.round(F.regr_slope("cut_odo", F.col("us") / 86_400e6), 4).alias("km_per_day"), F.countDistinct("us").alias("n")).filter("n >= 3").drop("n")


@query("a44_post_sale_messages", "SELECT market, cohort, count(*) FILTER (message='error') AS n, round(count(*) FILTER (message='error')*1000.0::DOUBLE/sum(trip_km),4) AS per_1000km FROM trips JOIN vehicles USING (vehicle_id) WHERE t_start>=TIMESTAMP '2023-12-01'+to_days(CAST(production_day+days_until_sale AS INTEGER)) GROUP BY ALL")
def a44(f):
    x = derive.annotate(joins.attach_static(f.trips, f.vehicles.select("vehicle_id", "market", "cohort")), derive.vehicle_clock(f.vehicles, ORIGIN)).filter("post_sale")
    return x.groupBy("market", "cohort").agg(F.count_if(F.col("message") == "error").alias("n"), F.round(F.count_if(F.col("message") == "error") * 1000 / F.sum("trip_km"), 4).alias("per_1000km"))


@query("a45_tercile_classes", "WITH e AS (SELECT quantile_cont(acctbal,1/3.0::DOUBLE) AS e1, quantile_cont(acctbal,2/3.0::DOUBLE) AS e2 FROM vehicles WHERE cohort='healthy') SELECT CAST(CASE WHEN acctbal>e2 THEN 2 WHEN acctbal>e1 THEN 1 ELSE 0 END AS INTEGER) AS class, cohort, count(*) AS n FROM vehicles CROSS JOIN e GROUP BY ALL")
def a45(f):
    cut = P.edges(f.vehicles.filter("cohort = 'healthy'"), "acctbal", (1 / 3, 2 / 3))
    return P.assign(f.vehicles, cut, "acctbal", "class").groupBy("class", "cohort").agg(F.count("*").alias("n"))


@query("a46_days_covered", "SELECT vehicle_id, round(greatest((epoch_us(max(t_end))-epoch_us(min(t_start)))/86400000000.0::DOUBLE,1.0),6) AS days FROM trips GROUP BY 1")
def a46(f):
    from ..plans.panel import days_covered

    return f.trips.groupBy("vehicle_id").agg(F.round(days_covered(), 6).alias("days"))


@query("a47_panel_funnel", "SELECT cut_odo, count(*) AS n, count(*) FILTER (label=1) AS positives, round(quantile_cont(km_after,0.5),4) AS exposure_p50 FROM cuts GROUP BY 1")
def a47(f):
    facts = [F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives")]
    return quantiles(f.cuts, ["cut_odo"], [("exposure_p50", "km_after", 0.5)], facts).withColumn("exposure_p50", F.round("exposure_p50", 4))


@query("a48_side_summary", "SELECT CASE WHEN vehicle_id%5=0 THEN 'test' ELSE 'dev' END AS side, count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT CASE WHEN event_observed=1 THEN vehicle_id END) AS event_vehicles, count(DISTINCT CASE WHEN label=1 THEN vehicle_id END) AS with_positive, round(avg(label),6) AS rate FROM cuts GROUP BY 1")
def a48(f):
    v = lambda c: F.countDistinct(F.when(c, F.col("vehicle_id")))
    return f.cuts.groupBy(F.when(F.col("vehicle_id") % 5 == 0, "test").otherwise("dev").alias("side")).agg(F.count("*").alias("rows"), F.countDistinct("vehicle_id").alias("vehicles"), v(F.col("event_observed") == 1).alias("event_vehicles"), v(F.col("label") == 1).alias("with_positive"), F.round(F.avg("label"), 6).alias("rate"))


@query("a49_event_clock_table", " UNION ALL ".join(f"SELECT '{s}' AS scale, count(*) AS n, round(stddev_samp(ln({s})),6) AS sd_log, round(quantile_cont({s},0.5),4) AS median FROM (SELECT event_odo, CAST(event_day-production_day AS DOUBLE) AS age, CAST(event_day-production_day-days_until_sale AS DOUBLE) AS dss FROM event_odo JOIN vehicles USING (vehicle_id)) WHERE {s}>0" for s in ("event_odo", "age", "dss")))
def a49(f):
    x = f.event_odo.join(f.vehicles, "vehicle_id").select("event_odo", (F.col("event_day") - F.col("production_day")).alias("age"), (F.col("event_day") - F.col("production_day") - F.col("days_until_sale")).alias("dss"))
    y = P.unpivot(x, [], ["event_odo", "age", "dss"], "scale").filter("value > 0")
    facts = [F.count("*").alias("n"), F.round(F.stddev_samp(F.log("value")), 6).alias("sd_log")]
    return quantiles(y, ["scale"], [("median", "value", 0.5)], facts).withColumn("median", F.round("median", 4))


ORD = "CASE WHEN time_to_event_km IS NULL THEN 0 WHEN time_to_event_km>600 THEN 1 WHEN time_to_event_km>300 THEN 2 ELSE 3 END"


@query("a50_ordinal_composition", f"SELECT {ORD} AS class, count(*) AS n, count(DISTINCT vehicle_id) AS vehicles, round(avg(event_observed),6) AS event_share FROM cuts GROUP BY 1")
def a50(f):
    t = F.col("time_to_event_km")
    c = F.when(t.isNull(), 0).when(t > 600, 1).when(t > 300, 2).otherwise(3)
    return f.cuts.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.countDistinct("vehicle_id").alias("vehicles"), F.round(F.avg("event_observed"), 6).alias("event_share"))


@query("t01_sorted_sink", "SELECT vehicle_id, event_id, row_number() OVER (ORDER BY vehicle_id, t_start, event_id) AS k FROM trips")
def t01(f):
    # places come from counts by vehicle, and running counts of these from ranges, so that no task sorts all rows
    n = joins.running_counts(f.trips.groupBy("vehicle_id").agg(F.count("*").alias("n")), [], "vehicle_id", ["n"])
    x = f.trips.withColumn("i", F.row_number().over(derive.by_time())).join(n.select("vehicle_id", "n_below"), "vehicle_id")
    return x.select("vehicle_id", "event_id", (F.col("n_below") + F.col("i")).alias("k"))


@query("t02_top_k_per_group", f"SELECT vehicle_id, event_id, value FROM trips QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY value DESC, event_id)<=3")
def t02(f):
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("value"), "event_id")
    return f.trips.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("vehicle_id", "event_id", "value")


@query("t03_reproducible_sample", "SELECT event_id, vehicle_id FROM trips ORDER BY md5(CAST(event_id AS VARCHAR)||'|7'), event_id LIMIT 200")
def t03(f):
    return f.trips.orderBy(F.md5(F.concat_ws("|", F.col("event_id").cast("string"), F.lit("7"))), "event_id").limit(200).select("event_id", "vehicle_id")


@query("f01_math", "SELECT event_id, floor(value/25)*25.0::DOUBLE AS lo, ceil(value/25)*25.0::DOUBLE AS hi, round(ln(1+value),6) AS log1p, round(exp(-value/100),6) AS decay, sign(level_end-50)::DOUBLE AS sgn, abs(level_end-50) AS dist, round_even(level_end/2,0) AS half FROM trips")
def f01(f):
    v, x = F.col("value"), F.col("level_end")
    return f.trips.select("event_id", (F.floor(v / 25) * 25.0).alias("lo"), (F.ceil(v / 25) * 25.0).alias("hi"), F.round(F.log1p(v), 6).alias("log1p"), F.round(F.exp(-v / 100), 6).alias("decay"), F.signum(x - 50).alias("sgn"), F.abs(x - 50).alias("dist"), F.bround(x / 2, 0).alias("half"))


@query("f02_dates", "SELECT event_id, CAST(t_start::DATE - DATE '1970-01-01' AS INTEGER) AS epoch_day, strftime(t_start,'%Y-%m') AS month, CAST(quarter(t_start) AS INTEGER) AS quarter, CAST(hour(t_start) AS INTEGER) AS hour, CAST(dayofweek(t_start)+1 AS INTEGER) AS weekday FROM trips")
def f02(f):
    t = F.col("t_start")
    return f.trips.select("event_id", F.unix_date(F.to_date(t)).alias("epoch_day"), F.date_format(t, "yyyy-MM").alias("month"), F.quarter(t).alias("quarter"), F.hour(t).alias("hour"), F.dayofweek(t).alias("weekday"))


@query("f03_strings", "SELECT c_custkey AS vehicle_id, replace(c_name,'Customer#','V') AS code, regexp_extract(c_name,'#0*([0-9]+)$',1) AS digits, c_mktsegment||'|'||c_nationkey AS cell, split_part(c_name,'#',1) AS head FROM customer")
def f03(f):
    c = f.table("customer")
    return c.select(F.col("c_custkey").alias("vehicle_id"), F.replace("c_name", F.lit("Customer#"), F.lit("V")).alias("code"), F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("digits"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cell"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"))


@query("f04_digests", "SELECT vehicle_id, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM trips GROUP BY 1")
def f04(f):
    return f.trips.groupBy("vehicle_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ","), 256).alias("digest"))


@query("f05_arrays", f"SELECT vehicle_id, count(*) AS n, max(top) AS top, round(sum(d),4) AS climbed FROM (SELECT vehicle_id, max(level_end) OVER (PARTITION BY vehicle_id ORDER BY t_start, event_id ROWS UNBOUNDED PRECEDING) AS top, greatest(0.0::DOUBLE, level_end-level_start) AS d0, CASE WHEN level_start IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, level_end-level_start) END AS d FROM trips) GROUP BY 1")
def f05(f):
    by = Window.partitionBy("vehicle_id").orderBy("t_start", "event_id")
    x = f.trips.withColumn("step", F.col("level_end") - F.lag("level_end").over(by))
    climbed = F.sum(F.when(F.col("step").isNotNull(), F.greatest(F.lit(0.0), F.col("step"))))
    return x.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.max("level_end").alias("top"), F.round(climbed, 4).alias("climbed"))


@query("f06_json", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k, '{\"k\":'||json_extract_string(props,'$.k')||'}' AS again FROM events")
def f06(f):
    x = f.table("events").select("event_id", F.from_json("props", "k int").alias("p"))
    return x.select("event_id", "p.k", F.to_json("p").alias("again"))
