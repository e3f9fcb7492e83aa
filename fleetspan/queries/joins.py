"""Queries of joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, derive, joins
from ..operators.quantiles import quantiles
from ..sources.fleet import ORIGIN
from .derive import MARKERS
from .registry import query

US = "epoch_us"


def _r(c, n=4):
    return F.round(c, n).alias(c)


@query("j01_attach_static", "SELECT market, engine, count(*) AS n, round(sum(trip_km),2) AS km FROM trips JOIN vehicles USING (vehicle_id) GROUP BY ALL")
def j01(f):
    return joins.attach_static(f.trips, f.vehicles).groupBy("market", "engine").agg(F.count("*").alias("n"), F.round(F.sum("trip_km"), 2).alias("km"))


@query("j02_orphans", "SELECT vehicle_id, count(*) AS n FROM trips WHERE vehicle_id NOT IN (SELECT vehicle_id FROM vehicles WHERE market<>2) GROUP BY 1")
def j02(f):
    return joins.orphans(f.trips, f.vehicles.filter("market <> 2")).groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("j03_vehicle_table", "SELECT coalesce(v.vehicle_id,t.vehicle_id) AS vehicle_id, t.n IS NOT NULL AS in_trips, s.m IS NOT NULL AS in_signals, t.n AS n_trips, s.m AS n_severe FROM vehicles v FULL JOIN (SELECT vehicle_id, count(*) AS n FROM trips GROUP BY 1) t USING (vehicle_id) FULL JOIN (SELECT vehicle_id, count(*) AS m FROM trips WHERE message='error' GROUP BY 1) s USING (vehicle_id)")
def j03(f):
    t = f.trips.groupBy("vehicle_id").agg(F.count("*").alias("n_trips"))
    s = f.trips.filter("message = 'error'").groupBy("vehicle_id").agg(F.count("*").alias("n_severe"))
    return joins.vehicle_table(f.vehicles.select("vehicle_id"), t, s).select("vehicle_id", "in_trips", "in_signals", "n_trips", "n_severe")


@query("j04_enrichment_audit", "SELECT count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (vehicle_id%5=1) AS n_orphans, CAST(0 AS BIGINT) AS n_repeated_keys FROM trips")
def j04(f):
    return joins.enrichment_report(f.trips, f.vehicles.filter("vehicle_id % 5 <> 1"))


@query("j05_asof_event_odometer", "SELECT vehicle_id, odo_before, odo_after, source, round(event_odo,4) AS event_odo, odo_after-odo_before AS uncertainty_km FROM event_odo")
def j05(f):
    return f.event_odo.select("vehicle_id", "odo_before", "odo_after", "source", _r("event_odo"), (F.col("odo_after") - F.col("odo_before")).alias("uncertainty_km"))


@query("j06_event_position_in_history", "SELECT vehicle_id, round(any_value(event_odo),4) AS event_odo, count(*) FILTER (t_start<=event_date) AS n_before, round(count(*) FILTER (t_start<=event_date)/count(*)::DOUBLE,6) AS share_before FROM event_odo JOIN trips USING (vehicle_id) GROUP BY 1")
def j06(f):
    x = f.trips.join(f.event_odo.select("vehicle_id", "event_date", "event_odo"), "vehicle_id")
    before = F.count_if(F.col("t_start") <= F.col("event_date"))
    return x.groupBy("vehicle_id").agg(F.round(F.first("event_odo"), 4).alias("event_odo"), before.alias("n_before"), F.round(before / F.count("*"), 6).alias("share_before"))


@query("j07_odometer_to_date", """WITH t AS (SELECT vehicle_id, odo_end AS o, epoch_us(min(t_start)) AS t0, epoch_us(max(t_start)) AS t1 FROM trips GROUP BY 1,2),
  p AS (SELECT vehicle_id, cut_odo+37 AS x FROM cuts UNION ALL SELECT vehicle_id, -5.0 FROM vehicles WHERE vehicle_id IN (SELECT vehicle_id FROM trips) UNION ALL SELECT vehicle_id, max(odo_end) FROM trips GROUP BY 1)
  SELECT p.vehicle_id, x, CASE WHEN o1=x THEN a0 WHEN o0 IS NOT NULL AND o1 IS NOT NULL THEN CAST(round(b1+(a0-b1)*(x-o0)/(o1-o0)) AS BIGINT) END AS us FROM (
    SELECT p.vehicle_id, p.x, max(o) FILTER (o<=x) AS o0, min(o) FILTER (o>=x) AS o1, arg_max(t1,o) FILTER (o<=x) AS b1, arg_min(t0,o) FILTER (o>=x) AS a0 FROM p JOIN t USING (vehicle_id) GROUP BY ALL) p""")
def j07(f):
    ends = f.trips.groupBy("vehicle_id").agg(F.max("odo_end").alias("x"))
    pts = f.cuts.select("vehicle_id", (F.col("cut_odo") + 37).alias("x")).union(ends.select("vehicle_id", F.lit(-5.0))).union(ends)
    return asof.project_odometer_to_dates(pts, f.trips, "x").select("vehicle_id", "x", F.unix_micros("date").alias("us"))


@query("j08_forward_date", "SELECT c.vehicle_id, c.cut_odo, epoch_us(min(t.t_start)) AS us FROM cuts c JOIN trips t ON t.vehicle_id=c.vehicle_id AND t.odo_end>=c.cut_odo GROUP BY ALL")
def j08(f):
    return asof.forward_date(f.cuts.select("vehicle_id", "cut_odo"), f.trips, "cut_odo").select("vehicle_id", "cut_odo", F.unix_micros("date").alias("us"))


@query("j09_nearest_within_tolerance", """SELECT event_id, CASE WHEN g<=86400 THEN CASE WHEN b THEN l0 ELSE l1 END END AS near_level, CASE WHEN g<=86400 THEN round(g,3) END AS gap_s FROM (SELECT *, coalesce(d0<=d1, d0 IS NOT NULL) AS b, CASE WHEN coalesce(d0<=d1, d0 IS NOT NULL) THEN d0 ELSE d1 END/1e6::DOUBLE AS g FROM (
  SELECT p.event_id, min(epoch_us(p.t_start)-epoch_us(s.t_start)) FILTER (s.t_start<=p.t_start) AS d0, min(epoch_us(s.t_start)-epoch_us(p.t_start)) FILTER (s.t_start>=p.t_start) AS d1, arg_max(s.level_end,s.t_start) FILTER (s.t_start<=p.t_start) AS l0, arg_min(s.level_end,s.t_start) FILTER (s.t_start>=p.t_start) AS l1
  FROM trips p LEFT JOIN (SELECT * FROM trips WHERE message='error') s ON s.vehicle_id=p.vehicle_id WHERE p.message='purchase' GROUP BY 1))""")
def j09(f):
    p = f.trips.filter("message = 'purchase'").select("vehicle_id", "event_id", "t_start")
    s = f.trips.filter("message = 'error'").select("vehicle_id", F.col("t_start").alias("t"), F.col("level_end").alias("near_level"))
    return asof.nearest(p, s, "vehicle_id", "t_start", "t", ["near_level"], 86400).select("event_id", "near_level", _r("gap_s", 3))


REG = "(SELECT vehicle_id, unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', TIMESTAMP '2023-12-25']) AS d FROM (SELECT DISTINCT vehicle_id FROM trips))"
ODO_AT = f"""(SELECT vehicle_id, d, CASE WHEN o0 IS NULL OR o1 IS NULL THEN coalesce(o0,o1) WHEN u0=u1 THEN o0 ELSE o0+(o1-o0)*(epoch_us(d)-u0)/CAST(u1-u0 AS DOUBLE) END AS odo FROM (SELECT p.vehicle_id, p.d, max(odo_end) FILTER (t_start<=d) AS o0, min(odo_end) FILTER (t_start>=d) AS o1, max(epoch_us(t_start)) FILTER (t_start<=d) AS u0, min(epoch_us(t_start)) FILTER (t_start>=d) AS u1 FROM {REG} p JOIN trips USING (vehicle_id) GROUP BY ALL))"""


def registry_points(f, *dates):
    ids = f.trips.select("vehicle_id").distinct()
    return ids.withColumn("d", F.explode(F.array(*(F.lit(d).cast("timestamp") for d in dates))))


@query("j10_odometer_at_time", f"SELECT vehicle_id, epoch_us(d) AS us, round(odo,4) AS odo FROM {ODO_AT}")
def j10(f):
    return asof.odometer_at(registry_points(f, "2024-01-05", "2024-01-25", "2023-12-25"), f.trips, "d").select("vehicle_id", F.unix_micros("d").alias("us"), _r("odo"))


@query("j11_calendar_profile", """SELECT cohort, age, count(odo) AS n, round(quantile_cont(odo,0.25),4) AS q1, round(quantile_cont(odo,0.5),4) AS median, round(quantile_cont(odo,0.75),4) AS q3 FROM (
  SELECT g.vehicle_id, g.cohort, g.age, max(t.odo_end) AS odo FROM (SELECT vehicle_id, cohort, unnest(generate_series(30,60,5)) AS age, production_day FROM vehicles WHERE vehicle_id IN (SELECT vehicle_id FROM trips)) g LEFT JOIN trips t ON t.vehicle_id=g.vehicle_id AND t.t_start<=TIMESTAMP '2023-12-01'+to_days(CAST(g.production_day+g.age AS INTEGER)) GROUP BY ALL) GROUP BY ALL""")
def j11(f):
    v = f.vehicles.join(f.trips.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    g = v.select("vehicle_id", "cohort", F.explode(F.sequence(F.lit(30), F.lit(60), F.lit(5))).alias("age"), "production_day")
    g = g.select("vehicle_id", "cohort", F.col("age").cast("bigint").alias("age"), asof.day_on_calendar(F.lit(ORIGIN), F.col("production_day") + F.col("age")).alias("d"))
    x = asof.backward(g, f.trips, "vehicle_id", "d", "t_start", ["odo_end"])
    q = quantiles(x, ["cohort", "age"], [("q1", "odo_end", 0.25), ("median", "odo_end", 0.5), ("q3", "odo_end", 0.75)], [F.count("odo_end").alias("n")])
    return q.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("j12_window_range_join", "SELECT vehicle_id, cut_odo, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM win GROUP BY ALL")
def j12(f):
    return f.windowed.groupBy("vehicle_id", "cut_odo").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("j13_marker_distance", f"SELECT e.vehicle_id, round(min(CASE WHEN a IS NOT NULL THEN greatest(0, epoch_us(a)-epoch_us(event_date), epoch_us(event_date)-epoch_us(b)) END)/86400000000.0::DOUBLE,6) AS distance_days FROM event_dates e LEFT JOIN (SELECT * FROM {MARKERS} WHERE marker='long_gap') m USING (vehicle_id) GROUP BY 1")
def j13(f):
    m = derive.intervention_markers(f.trips).filter("marker = 'long_gap'")
    return joins.min_distance(f.event_dates, m, "event_date").select("vehicle_id", F.round("distance_days", 6).alias("distance_days"))


@query("j14_fallback_lookup", """WITH m AS (SELECT vehicle_id, strftime(t_start,'%d') AS month, market, level_end FROM trips JOIN vehicles USING (vehicle_id)), a AS (SELECT market, month, avg(level_end) AS v FROM m GROUP BY ALL HAVING count(*)>=70), b AS (SELECT month, avg(level_end) AS v FROM m GROUP BY ALL HAVING count(*)>=335), c AS (SELECT avg(level_end) AS v FROM m)
  SELECT x.market, x.month, round(coalesce(a.v,b.v,c.v),4) AS v, CASE WHEN a.v IS NOT NULL THEN 'cell' WHEN b.v IS NOT NULL THEN 'month' ELSE 'all' END AS level FROM (SELECT DISTINCT market, month FROM m) x LEFT JOIN a USING (market, month) LEFT JOIN b USING (month) CROSS JOIN c""")
def j14(f):
    m = joins.attach_static(f.trips, f.vehicles).select("market", F.date_format("t_start", "dd").alias("month"), "level_end")
    agg = lambda keys, n: m.groupBy(*keys).agg(F.avg("level_end").alias("v"), F.count("*").alias("k")).filter(F.col("k") >= n).drop("k")
    return joins.fallback_lookup(m.select("market", "month").distinct(), [("cell", ["market", "month"], agg(["market", "month"], 70)), ("month", ["month"], agg(["month"], 335)), ("all", [], agg([], 0))], "v").select("market", "month", _r("v"), "level")


@query("j15_attach_columns", "SELECT vehicle_id, cut_odo, score, n FROM scores JOIN (SELECT vehicle_id, cut_odo, count(*) AS n FROM win GROUP BY ALL) USING (vehicle_id, cut_odo)")
def j15(f):
    return joins.attach_columns(f.scores.select("vehicle_id", "cut_odo", "score"), f.windowed.groupBy("vehicle_id", "cut_odo").agg(F.count("*").alias("n")), ["vehicle_id", "cut_odo"])


@query("j16_align_runs", "SELECT count(*) AS n_rows, count(*) FILTER (vehicle_id%9=0) AS n_mismatch FROM scores")
def j16(f):
    s = f.scores.select("vehicle_id", "cut_odo", "label", "score")
    other = s.withColumns({"label": F.when(F.col("vehicle_id") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")), "score": 1 - F.col("score")})
    return joins.align_runs([s, other], ["vehicle_id", "cut_odo"], ["label"])[1]


@query("j17_reference_deviation", """WITH m AS (SELECT vehicle_id, market, strftime(t_start,'%Y-%m') AS month, level_end, cohort FROM trips JOIN vehicles USING (vehicle_id)), r AS (SELECT market, month, avg(level_end) AS ref FROM m WHERE cohort='healthy' GROUP BY ALL)
  SELECT vehicle_id, round(avg(level_end-ref),4) AS deviation FROM m LEFT JOIN r USING (market, month) GROUP BY 1""")
def j17(f):
    m = joins.attach_static(f.trips, f.vehicles).withColumn("month", F.date_format("t_start", "yyyy-MM"))
    return joins.reference_deviation(m, ["market", "month"], "level_end", F.col("cohort") == "healthy").groupBy("vehicle_id").agg(F.round(F.avg("deviation"), 4).alias("deviation"))


@query("j18_small_dimension_lookup", "SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey GROUP BY ALL")
def j18(f):
    d = f.table("nation").join(f.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return joins.attach_static(f.table("customer"), d, "c_nationkey").groupBy("region", "nation").agg(F.count("*").alias("n"))


SURV = "(SELECT vehicle_id, cut_odo, CASE WHEN event_observed=1 THEN time_to_event_km ELSE km_after END AS duration, event_observed AS event, score, CAST(vehicle_id%3 AS DOUBLE)*100 AS entry, CAST(cut_odo AS BIGINT) AS landmark FROM scores)"


def survival(f):
    return f.scores.select("vehicle_id", "cut_odo", F.when(F.col("event_observed") == 1, F.col("time_to_event_km")).otherwise(F.col("km_after")).alias("duration"), F.col("event_observed").alias("event"), "score", ((F.col("vehicle_id") % 3) * 100).cast("double").alias("entry"), F.col("cut_odo").cast("bigint").alias("landmark"))


@query("j19_comparable_pairs", f"SELECT i.landmark, count(*) AS n_pairs, count(*) FILTER (i.score>j.score) AS concordant, count(*) FILTER (i.score=j.score) AS ties FROM {SURV} i JOIN {SURV} j ON i.landmark=j.landmark AND i.event=1 AND j.entry<i.duration AND (j.duration>i.duration OR (j.duration=i.duration AND j.event=0)) GROUP BY 1")
def j19(f):
    return joins.comparable_pairs(survival(f), group="landmark", entry="entry")


@query("j20_vehicle_matrix", "SELECT v.vehicle_id, v.market, t.n, s.m FROM vehicles v LEFT JOIN (SELECT vehicle_id, count(*) AS n FROM trips GROUP BY 1) t USING (vehicle_id) LEFT JOIN (SELECT vehicle_id, count(*) AS m FROM cuts GROUP BY 1) s USING (vehicle_id)")
def j20(f):
    return joins.matrix([f.vehicles.select("vehicle_id", "market"), joins.attach_static(f.trips, f.vehicles).groupBy("vehicle_id").agg(F.first("market").alias("market"), F.count("*").alias("n")), f.cuts.groupBy("vehicle_id").agg(F.count("*").alias("m"))])


@query("j21_code_transition", "SELECT a.cohort AS before, b.cohort AS after, count(*) AS n, count(*) FILTER (a.cohort IS NOT DISTINCT FROM b.cohort) AS n_same FROM (SELECT vehicle_id, cohort FROM vehicles WHERE vehicle_id%7<>0) a FULL JOIN (SELECT vehicle_id, CASE WHEN vehicle_id%6=0 THEN 'healthy' ELSE cohort END AS cohort FROM vehicles WHERE vehicle_id%11<>0) b USING (vehicle_id) GROUP BY ALL")
def j21(f):
    v = f.vehicles.select("vehicle_id", "cohort")
    return joins.code_transition(v.filter("vehicle_id % 7 <> 0"), v.filter("vehicle_id % 11 <> 0").withColumn("cohort", F.when(F.col("vehicle_id") % 6 == 0, "healthy").otherwise(F.col("cohort"))), "vehicle_id", "cohort")


@query("j22_event_two_readings", """SELECT vehicle_id, o1 IS NOT NULL AND o2 IS NOT NULL AND o1=o2 AS same, round(o1,4) AS by_production, round(o2,4) AS by_sale FROM (SELECT vehicle_id, max(odo_end) FILTER (t_start<=d1) AS o1, max(odo_end) FILTER (t_start<=d2) AS o2 FROM trips JOIN (SELECT vehicle_id, event_date AS d1, event_date-to_days(CAST(days_until_sale//4 AS INTEGER)) AS d2 FROM event_dates JOIN vehicles USING (vehicle_id)) USING (vehicle_id) GROUP BY 1)""")
def j22(f):
    e = f.event_dates.join(f.vehicles.select("vehicle_id", "days_until_sale"), "vehicle_id").select("vehicle_id", "event_date", F.timestamp_micros(F.unix_micros("event_date") - F.floor(F.col("days_until_sale") / 4) * 86_400_000_000).alias("d2"))
    a = asof.backward(e.select("vehicle_id", "event_date"), f.trips, "vehicle_id", "event_date", "t_start", ["odo_end"]).select("vehicle_id", F.col("odo_end").alias("o1"))
    b = asof.backward(e.select("vehicle_id", "d2"), f.trips, "vehicle_id", "d2", "t_start", ["odo_end"]).select("vehicle_id", F.col("odo_end").alias("o2"))
    x = a.join(b, "vehicle_id", "full_outer").join(f.trips.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    return x.select("vehicle_id", F.coalesce(F.col("o1") == F.col("o2"), F.lit(False)).alias("same"), F.round("o1", 4).alias("by_production"), F.round("o2", 4).alias("by_sale"))


CUT_DATE = "(SELECT vehicle_id, cut_odo, max(t_end) AS cut_date, round(avg(level_end)/100,6) AS score FROM win GROUP BY ALL)"


def dated_scores(f):
    return f.windowed.groupBy("vehicle_id", "cut_odo").agg(F.max("t_end").alias("cut_date"), F.round(F.avg("level_end") / 100, 6).alias("score"))


@query("j23_last_earlier_score", f"SELECT cut_odo, count(*) AS n, count(other) AS matched, round(sum(other),4) AS total FROM (SELECT a.vehicle_id, a.cut_odo, last(b.score ORDER BY b.cut_date, b.score) AS other FROM {CUT_DATE} a LEFT JOIN {CUT_DATE} b ON a.vehicle_id=b.vehicle_id AND b.cut_odo%200=0 AND b.cut_date<=a.cut_date GROUP BY ALL) GROUP BY 1")
def j23(f):
    a = dated_scores(f)
    b = a.filter("cut_odo % 200 = 0").select("vehicle_id", F.col("cut_date").alias("d"), F.col("score").alias("other"))
    x = asof.backward(a.select("vehicle_id", "cut_odo", "cut_date"), b, "vehicle_id", "cut_date", "d", ["other"])
    return x.groupBy("cut_odo").agg(F.count("*").alias("n"), F.count("other").alias("matched"), F.round(F.sum("other"), 4).alias("total"))


@query("j24_event_odometer_consistency", "SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS max_abs_diff FROM cuts WHERE event_observed=1")
def j24(f):
    x = f.cuts.filter("event_observed = 1").select("vehicle_id", (F.col("cut_odo") + F.col("time_to_event_km")).alias("implied")).join(f.event_odo.select("vehicle_id", F.col("event_odo").alias("again")), "vehicle_id")
    return x.agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("implied") - F.col("again"))), 6).alias("max_abs_diff"))


@query("j25_score_tables_compared", """WITH x AS (SELECT score AS sa, floor(score*50)/50 AS sb FROM scores), r AS (SELECT sa, sb, rank() OVER (ORDER BY sa)+(count(*) OVER (PARTITION BY sa)-1)/2.0::DOUBLE AS ra, rank() OVER (ORDER BY sb)+(count(*) OVER (PARTITION BY sb)-1)/2.0::DOUBLE AS rb FROM x)
  SELECT count(*) AS n_rows, round(max(abs(sa-sb)),6) AS max_abs_diff, count(*) FILTER (sa=sb) AS n_equal, count(*) FILTER (ra=rb) AS n_rank_equal, round(corr(ra,rb),6) AS rho FROM r""")
def j25(f):
    a = f.scores.select("vehicle_id", "cut_odo", "score")
    x = joins.score_drift(a, a.withColumn("score", F.floor(F.col("score") * 50) / 50), ["vehicle_id", "cut_odo"])
    return x.select("n_rows", _r("max_abs_diff", 6), "n_equal", "n_rank_equal", _r("rho", 6))
