"""Queries of alert windows, ranking metrics, splits and explanation tables (W, M, X, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import explain, joins, splits
from ..operators import metrics as M
from ..operators import profile as P
from ..operators.quantiles import quantiles
from ..sources.fleet import SUSTAIN
from .joins import SURV, survival
from .profile import PD, _r, exposure
from .registry import CTES, query

K = SUSTAIN
CTES["levels"] = "SELECT vehicle_id, max(event_observed) AS event_observed, max(run_min) AS level FROM (SELECT *, CASE WHEN count(*) OVER w=2 THEN min(score) OVER w END AS run_min FROM scores WINDOW w AS (PARTITION BY vehicle_id ORDER BY cut_odo ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) GROUP BY 1"
CTES["runs"] = "SELECT * FROM (SELECT *, min(score) OVER w AS run_min, count(*) OVER w AS nn FROM scores WINDOW w AS (PARTITION BY vehicle_id ORDER BY cut_odo ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE nn=2"
CTES["taus"] = "SELECT budget, n_healthy, m, (SELECT min(level) FROM (SELECT level, row_number() OVER (ORDER BY level DESC) AS k FROM levels WHERE event_observed=0 AND level IS NOT NULL) WHERE k=m+1) AS tau FROM (SELECT unnest([0.05::DOUBLE,0.1::DOUBLE,0.2::DOUBLE]) AS budget, count(*) AS n_healthy, CAST(floor(unnest([0.05::DOUBLE,0.1::DOUBLE,0.2::DOUBLE])*count(*)+1e-9) AS BIGINT) AS m FROM levels WHERE event_observed=0)"
BUDGETS = [0.05, 0.1, 0.2]
GRID = [0.4, 0.45, 0.5, 0.55, 0.6]
CURVE = """(SELECT tau, avg(CASE WHEN event_observed=1 THEN h END) AS detection, avg(CASE WHEN event_observed=0 THEN h END) AS false_alarms, quantile_cont(CASE WHEN event_observed=1 THEN lead END,0.25) AS lead_q1, quantile_cont(CASE WHEN event_observed=1 THEN lead END,0.5) AS lead_p50, quantile_cont(CASE WHEN event_observed=1 THEN lead END,0.75) AS lead_q3, 1-avg(CASE WHEN event_observed=1 THEN h END) AS never FROM (
  SELECT v.vehicle_id, v.tau, v.event_observed, CASE WHEN x.vehicle_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS h, lead FROM (SELECT vehicle_id, max(event_observed) AS event_observed, unnest([0.4::DOUBLE,0.45::DOUBLE,0.5::DOUBLE,0.55::DOUBLE,0.6::DOUBLE]) AS tau FROM scores GROUP BY 1) v LEFT JOIN (SELECT vehicle_id, tau, arg_min(time_to_event_km,cut_odo) AS lead FROM runs JOIN (SELECT unnest([0.4::DOUBLE,0.45::DOUBLE,0.5::DOUBLE,0.55::DOUBLE,0.6::DOUBLE]) AS tau) g ON run_min>=tau GROUP BY ALL) x ON x.vehicle_id=v.vehicle_id AND x.tau=v.tau) GROUP BY 1)"""


def auc_sql(src: str, by: str = "", score: str = "score", label: str = "label") -> str:
    """Mann-Whitney from ranks."""
    g, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"(SELECT {g}(sum(CASE WHEN y=1 THEN r END)-sum(y)*(sum(y)+1)/2)/nullif(sum(y)*sum(1-y),0)::DOUBLE AS auc, sum(y) AS n_pos, sum(1-y) AS n_neg FROM (SELECT {g}{label} AS y, rank() OVER ({p}ORDER BY {score})+(count(*) OVER (PARTITION BY {g}{score})-1)/2.0::DOUBLE AS r FROM {src}) {'GROUP BY ' + by if by else ''})"


def ap_sql(src: str, by: str = "") -> str:
    g, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"(SELECT {g}sum(p/pa*(tp/ta)) AS ap, max(pa)/max(na) AS base_rate FROM (SELECT {g}score, sum(label)::DOUBLE AS p, sum(sum(label)) OVER ({p}ORDER BY score DESC)::DOUBLE AS tp, sum(count(*)) OVER ({p}ORDER BY score DESC)::DOUBLE AS ta, sum(sum(label)) OVER ({p})::DOUBLE AS pa, sum(count(*)) OVER ({p})::DOUBLE AS na FROM {src} GROUP BY {g}score) {'GROUP BY ' + by if by else ''})"


def with_market(f):
    return f.scores.join(f.vehicles.select("vehicle_id", "market", "engine"), "vehicle_id")


SM = "(SELECT s.*, market, engine FROM scores s JOIN vehicles USING (vehicle_id))"


@query("w08_causal_mean", "SELECT vehicle_id, cut_odo, round(avg(score) OVER (PARTITION BY vehicle_id ORDER BY cut_odo ROWS UNBOUNDED PRECEDING)+1e-9,6) AS smooth FROM scores")
def w08(f):
    w = Window.partitionBy("vehicle_id").orderBy("cut_odo").rowsBetween(Window.unboundedPreceding, 0)
    return f.scores.select("vehicle_id", "cut_odo", F.round(F.avg("score").over(w) + 1e-9, 6).alias("smooth"))


@query("w09_first_sustained_alert", "SELECT vehicle_id, min(cut_odo) AS alert_odo, round(arg_min(coalesce(time_to_event_km,-1),cut_odo),4) AS lead_km FROM runs WHERE run_min>=0.5 GROUP BY 1")
def w09(f):
    return M.first_alerts(f.scores, 0.5, K).select("vehicle_id", "alert_odo", F.round(F.coalesce("lead_km", F.lit(-1.0)), 4).alias("lead_km"))


@query("w10_vehicle_level", "SELECT vehicle_id, event_observed, level FROM levels")
def w10(f):
    return M.vehicle_levels(f.scores, K)


@query("w13_percentile_rank", "SELECT vehicle_id, cut_odo, round((rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE)/count(*) OVER (),6) AS pr FROM scores")
def w13(f):
    return joins.average_rank(f.scores, "score", "pr", share=True).select("vehicle_id", "cut_odo", _r("pr", 6))


@query("w14_tail_relabel", "SELECT vehicle_id, cut_odo, CASE WHEN row_number() OVER (PARTITION BY vehicle_id ORDER BY cut_odo DESC)<=2 AND vehicle_id%4=0 THEN 1 ELSE 0 END AS label FROM scores")
def w14(f):
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("cut_odo"))
    return f.scores.withColumn("k", F.row_number().over(w)).select("vehicle_id", "cut_odo", ((F.col("k") <= 2) & (F.col("vehicle_id") % 4 == 0)).cast("int").alias("label"))


@query("w15_person_days", f"SELECT vehicle_id, count(*) AS days, CAST(sum(CASE WHEN day=ed THEN 1 ELSE 0 END) AS BIGINT) AS events, CAST(max(day-d0) AS INTEGER) AS last_dss FROM {PD} GROUP BY 1")
def w15(f):
    return exposure(f).groupBy("vehicle_id").agg(F.count("*").alias("days"), F.sum("is_event").alias("events"), F.max("dss").alias("last_dss"))


@query("w16_vehicle_constant", "SELECT vehicle_id, cut_odo, max(score) OVER (PARTITION BY vehicle_id) AS score FROM scores")
def w16(f):
    return M.vehicle_constant(f.scores, "score").select("vehicle_id", "cut_odo", "score")


@query("w17_first_cuts", "SELECT vehicle_id, cut_odo, score FROM scores QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY cut_odo)<=3")
def w17(f):
    w = Window.partitionBy("vehicle_id").orderBy("cut_odo")
    return f.scores.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("vehicle_id", "cut_odo", "score")


@query("w18_sequence_id_check", "SELECT vehicle_id, bool_and(coalesce(event_id>p,true)) AS rising, bool_and(coalesce(event_id=p+1,true)) AS step_one, count(DISTINCT event_id)=count(*) AS distinct_ids FROM (SELECT *, lag(event_id) OVER (PARTITION BY vehicle_id ORDER BY t_start, event_id) AS p FROM trips) GROUP BY 1")
def w18(f):
    x = f.trips.withColumn("p", F.lag("event_id").over(Window.partitionBy("vehicle_id").orderBy("t_start", "event_id")))
    return x.groupBy("vehicle_id").agg(F.bool_and(F.coalesce(F.col("event_id") > F.col("p"), F.lit(True))).alias("rising"), F.bool_and(F.coalesce(F.col("event_id") == F.col("p") + 1, F.lit(True))).alias("step_one"), (F.countDistinct("event_id") == F.count("*")).alias("distinct_ids"))


@query("m01_roc_auc", f"SELECT round(auc,6) AS auc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM {auc_sql('scores')}")
def m01(f):
    return M.roc_auc(f.scores).withColumn("auc", F.round("auc", 6))


@query("m02_average_precision_brier", f"SELECT round(ap,6) AS ap, round(base_rate,6) AS base_rate, round(ap/base_rate,6) AS lift, (SELECT round(avg(pow(score-label,2)),6) FROM scores) AS brier FROM {ap_sql('scores')}")
def m02(f):
    x = M.average_precision(f.scores).crossJoin(M.brier(f.scores))  # one row each
    return x.select(_r("ap", 6), _r("base_rate", 6), _r("lift", 6), _r("brier", 6))


@query("m03_stratified_auc", f"SELECT round(sum(auc*n_pos*n_neg)/sum(n_pos*n_neg),6) AS auc, CAST(sum(n_pos*n_neg) AS BIGINT) AS pairs FROM {auc_sql(SM, 'market')}")
def m03(f):
    return M.stratified_auc(with_market(f), ["market"]).withColumn("auc", F.round("auc", 6))


SEP = "(SELECT vehicle_id, CASE WHEN any_value(cohort)='failed' THEN 1 ELSE 0 END AS label, avg(level_end) AS level_end, avg(value) AS value FROM trips JOIN vehicles USING (vehicle_id) GROUP BY 1)"


@query("m04_cohort_separation", " UNION ALL ".join(f"SELECT '{v}' AS metric, round(auc,6) AS superior, (SELECT round(quantile_cont({v},0.5),4) FROM {SEP} WHERE label=1) AS median_failed, (SELECT round(quantile_cont({v},0.5),4) FROM {SEP} WHERE label=0) AS median_healthy FROM {auc_sql(SEP, score=v)}" for v in ("level_end", "value")))
def m04(f):
    x = joins.attach_static(f.trips, f.vehicles).groupBy("vehicle_id").agg((F.first("cohort") == "failed").cast("int").alias("label"), F.avg("level_end").alias("level_end"), F.avg("value").alias("value"))
    u = P.unpivot(x, ["label"], ["level_end", "value"])
    failed, healthy = (F.when(F.col("label") == y, F.col("value")) for y in (1, 0))
    med = quantiles(u, ["metric"], [("median_failed", failed, 0.5), ("median_healthy", healthy, 0.5)])
    med = med.withColumns({c: F.round(c, 4) for c in ("median_failed", "median_healthy")})
    return M.roc_auc(u, ["metric"], score="value").select("metric", F.round("auc", 6).alias("superior")).join(med, "metric")


@query("m05_cohort_ceiling", f"WITH e AS (SELECT label, event_observed::DOUBLE AS score FROM scores), w AS (SELECT label, score FROM scores WHERE event_observed=1) SELECT (SELECT round(ap,6) FROM {ap_sql('e')}) AS ceiling, (SELECT round(ap,6) FROM {ap_sql('w')}) AS within_failed")
def m05(f):
    a = M.average_precision(f.scores.withColumn("score", F.col("event_observed").cast("double"))).select(F.round("ap", 6).alias("ceiling"))
    b = M.average_precision(f.scores.filter("event_observed = 1")).select(F.round("ap", 6).alias("within_failed"))
    return a.crossJoin(b)  # one row each


@query("m06_within_vehicle_auc", f"SELECT round(avg(auc),6) AS auc, count(*) AS n_vehicles FROM {auc_sql('scores', 'vehicle_id')} WHERE auc IS NOT NULL")
def m06(f):
    return M.within_vehicle_auc(f.scores).withColumn("auc", F.round("auc", 6))


def curve(f):
    return M.threshold_curve(f.scores, GRID, K)


@query("m07_lead_time_curve", f"SELECT tau, round(detection,6) AS detection, round(false_alarms,6) AS false_alarms, round(lead_q1,4) AS lead_q1, round(lead_p50,4) AS lead_p50, round(lead_q3,4) AS lead_q3, round(never,6) AS never FROM {CURVE}")
def m07(f):
    return curve(f).select("tau", _r("detection", 6), _r("false_alarms", 6), _r("lead_q1"), _r("lead_p50"), _r("lead_q3"), _r("never", 6))


@query("m08_operating_point", f"SELECT tau, round(detection,6) AS detection, round(false_alarms,6) AS false_alarms FROM {CURVE} WHERE false_alarms<=0.4 ORDER BY detection DESC, tau LIMIT 1")
def m08(f):
    return M.operating_point(curve(f), 0.4).select("tau", _r("detection", 6), _r("false_alarms", 6))


DET = "(SELECT budget, avg(CASE WHEN event_observed=1 THEN h END) AS detection, avg(CASE WHEN event_observed=0 THEN h END) AS false_alarms FROM (SELECT budget, event_observed, CASE WHEN level>tau THEN 1.0::DOUBLE ELSE 0 END AS h FROM levels CROSS JOIN taus) GROUP BY 1)"


@query("m09_exact_detection_at_budget", f"SELECT budget, n_healthy, m, tau, round(detection,6) AS detection, round(false_alarms,6) AS false_alarms FROM taus JOIN {DET} USING (budget)")
def m09(f):
    lv = M.vehicle_levels(f.scores, K)
    t = M.exact_tau(lv, BUDGETS)
    return t.join(M.detection(lv, t), "budget").select("budget", "n_healthy", "m", "tau", _r("detection", 6), _r("false_alarms", 6))


POOL = "(SELECT vehicle_id, max(label) AS label, max(event_observed) AS event_observed, max(score) AS top, avg(score) AS mean, avg(CASE WHEN k<=3 THEN score END) AS topk, 1-exp(sum(ln(1-least(score,1-1e-12)))) AS noisy_or FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY score DESC, cut_odo) AS k FROM scores) GROUP BY 1)"


@query("m10_vehicle_pooling", f"SELECT vehicle_id, label, top AS max, round(mean+1e-9,6) AS mean, round(topk+1e-9,6) AS topk, round(noisy_or,6) AS noisy_or FROM {POOL}")
def m10(f):
    return M.pooled(f.scores).select("vehicle_id", "label", "max", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "topk")), _r("noisy_or", 6))


@query("m11_bag_detection", f"WITH l AS (SELECT vehicle_id, event_observed, round(mean,6) AS level FROM {POOL}), t AS (SELECT (SELECT min(level) FROM (SELECT level, row_number() OVER (ORDER BY level DESC) AS k FROM l WHERE event_observed=0) WHERE k=1+(SELECT CAST(floor(0.1::DOUBLE*count(*)+1e-9) AS BIGINT) FROM l WHERE event_observed=0)) AS tau) SELECT 0.1::DOUBLE AS budget, round(avg(CASE WHEN event_observed=1 THEN CASE WHEN level>tau THEN 1.0::DOUBLE ELSE 0 END END),6) AS detection FROM l CROSS JOIN t")
def m11(f):
    lv = M.pooled(f.scores).select("vehicle_id", "event_observed", F.round("mean", 6).alias("level"))
    return M.detection(lv, M.exact_tau(lv, [0.1])).select("budget", _r("detection", 6))


@query("m12_cost_ratio_sweep", "WITH h AS (SELECT score AS s, sum(label) AS p, count(*)-sum(label) AS n FROM scores GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pa, sum(n) OVER () AS na FROM h), x AS (SELECT ratio, s, ratio*(pa-tp)+fp AS cost, pa, na FROM c CROSS JOIN (SELECT unnest([1.0::DOUBLE,5.0::DOUBLE,20.0::DOUBLE]) AS ratio)) SELECT ratio, first(s ORDER BY cost, s) AS tau, min(cost) AS cost, max(na)::DOUBLE AS cost_all, max(ratio*pa) AS cost_none FROM x GROUP BY 1")
def m12(f):
    return M.cost_curve(f.scores, [1.0, 5.0, 20.0])


@query("m13_expected_cost_scenarios", f"WITH s AS (SELECT m AS miss, v AS visit, e AS effectiveness, p AS prevalence FROM (SELECT unnest([5000.0::DOUBLE]) AS m, unnest([200.0::DOUBLE]) AS v) CROSS JOIN (SELECT unnest([0.5::DOUBLE,0.9::DOUBLE]) AS e) CROSS JOIN (SELECT unnest([0.05::DOUBLE,0.2::DOUBLE]) AS p)), x AS (SELECT s.*, tau, round(prevalence*(1-detection*effectiveness)*miss+(prevalence*detection+(1-prevalence)*false_alarms)*visit,9) AS cost, prevalence*detection/nullif(prevalence*detection+(1-prevalence)*false_alarms,0) AS ppv FROM {CURVE} CROSS JOIN s) SELECT miss, visit, effectiveness, prevalence, round(min(cost),6) AS cost, first(tau ORDER BY cost, tau) AS tau, round(first(ppv ORDER BY cost, tau),6) AS ppv FROM x GROUP BY ALL")
def m13(f):
    s = P.grid(f.spark, miss=(5000,), visit=(200,), effectiveness=(0.5, 0.9), prevalence=(0.05, 0.2))
    return M.expected_cost(curve(f), s).select("miss", "visit", "effectiveness", "prevalence", _r("cost", 6), "tau", _r("ppv", 6))


PAIRS = "SELECT {g} count(*) AS n_pairs, round((count(*) FILTER (i.score>j.score)+count(*) FILTER (i.score=j.score)/2.0::DOUBLE)/count(*),6) AS c_index FROM {s} i JOIN {s} j ON {c} i.event=1 AND j.entry<i.duration AND (j.duration>i.duration OR (j.duration=i.duration AND j.event=0)) {e}"


@query("m14_concordance", PAIRS.format(g="", s=SURV.replace("CAST(vehicle_id%3 AS DOUBLE)*100", "0.0::DOUBLE"), c="", e=""))
def m14(f):
    return M.concordance(survival(f)).select("n_pairs", _r("c_index", 6))


@query("m15_late_entry_concordance", PAIRS.format(g="i.landmark,", s=SURV, c="i.landmark=j.landmark AND", e="GROUP BY 1"))
def m15(f):
    return M.concordance(survival(f), "landmark", "entry").select("landmark", "n_pairs", _r("c_index", 6))


@query("m16_landmark_block", f"SELECT a.cut_odo, round(auc,6) AS auc, CAST(n_pos AS BIGINT) AS n_pos, round(ap,6) AS ap FROM {auc_sql('scores', 'cut_odo')} a JOIN {ap_sql('scores', 'cut_odo')} b USING (cut_odo) WHERE n_pos>0")
def m16(f):
    a, b = M.roc_auc(f.scores, ["cut_odo"]), M.average_precision(f.scores, ["cut_odo"])
    return a.filter("n_pos > 0").join(b, "cut_odo").select("cut_odo", _r("auc", 6), "n_pos", _r("ap", 6))


@query("m17_calibration_classes", "SELECT CAST(least(2,floor(r*3)) AS INTEGER) AS class, count(*) AS n, round(avg(score),6) AS expected, round(avg(label),6) AS observed FROM (SELECT *, (rank() OVER (ORDER BY score)+(count(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE)/count(*) OVER () AS r FROM scores) GROUP BY 1")
def m17(f):
    return M.calibration(f.scores).select("class", "n", _r("expected", 6), _r("observed", 6))


REP = "(SELECT s.*, unnest([0,1,2]) AS repeat FROM scores s)"


def repeated(f, n=3):
    """Scores of n repeats, each of its own noise by a hash."""
    r = f.scores.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    noise = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("repeat").cast("string"), F.col("vehicle_id").cast("string"), F.col("cut_odo").cast("bigint").cast("string"))), 1, 4), 16, 10).cast("double") / 65536
    return r.withColumn("score", F.round(F.col("score") * 0.8 + noise * 0.2, 6))


CTES["rep"] = "SELECT vehicle_id, cut_odo, label, event_observed, time_to_event_km, km_after, repeat, round(score*0.8+(CAST('0x'||md5(repeat||'|'||vehicle_id||'|'||CAST(cut_odo AS BIGINT))[1:4] AS BIGINT)/65536.0::DOUBLE)*0.2,6) AS score FROM (SELECT s.*, unnest([0,1,2]) AS repeat FROM scores s)"


@query("m18_dispersion_over_repeats", f"SELECT round(avg(auc),6) AS mean, round(stddev_pop(auc),6) AS sd, round(min(auc),6) AS lo, round(max(auc),6) AS hi FROM {auc_sql('rep', 'repeat')}")
def m18(f):
    return M.roc_auc(repeated(f), ["repeat"]).agg(F.round(F.avg("auc"), 6).alias("mean"), F.round(F.stddev_pop("auc"), 6).alias("sd"), F.round(F.min("auc"), 6).alias("lo"), F.round(F.max("auc"), 6).alias("hi"))


@query("m19_spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x,y),6) AS rho FROM (SELECT rank() OVER (ORDER BY {a})+(count(*) OVER (PARTITION BY {a})-1)/2.0::DOUBLE AS x, rank() OVER (ORDER BY {b})+(count(*) OVER (PARTITION BY {b})-1)/2.0::DOUBLE AS y FROM scores)" for a, b in (("score", "cut_odo"), ("score", "km_after"), ("score", "label"))))
def m19(f):
    out = None
    for a, b in (("score", "cut_odo"), ("score", "km_after"), ("score", "label")):
        x = P.ranked_corr(f.scores, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), _r("rho", 6))
        out = x if out is None else out.unionByName(x)
    return out


BANDS = "CAST(floor(time_to_event_km/200) AS BIGINT)"


@query("m20_anticipation_by_band", f"SELECT band, round(auc,6) AS auc, CAST(n_pos AS BIGINT) AS n_pos FROM {auc_sql(f'(SELECT {BANDS} AS band, score, 1 AS label FROM scores WHERE event_observed=1 AND time_to_event_km<1000 UNION ALL SELECT b, score, 0 FROM scores CROSS JOIN (SELECT unnest([0,1,2,3,4])::BIGINT AS b) WHERE event_observed=0)', 'band')} WHERE n_pos>0")
def m20(f):
    ev = f.scores.filter("event_observed = 1 and time_to_event_km < 1000").select(F.floor(F.col("time_to_event_km") / 200).alias("band"), "score", F.lit(1).alias("label"))
    no = f.scores.filter("event_observed = 0").select(F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(5)))).alias("band"), "score", F.lit(0).alias("label"))
    return M.roc_auc(ev.unionByName(no), ["band"]).filter("n_pos > 0").select("band", _r("auc", 6), "n_pos")


@query("m21_early_trait", f"SELECT market, round(auc,6) AS auc, CAST(n_pos*n_neg AS BIGINT) AS pairs FROM {auc_sql('(SELECT vehicle_id, any_value(market) AS market, CASE WHEN any_value(cohort)=$$failed$$ THEN 1 ELSE 0 END AS label, round(avg(level_end),6) AS score FROM trips JOIN vehicles USING (vehicle_id) WHERE odo_end<=800 GROUP BY 1)', 'market')}")
def m21(f):
    x = joins.attach_static(f.trips, f.vehicles).filter("odo_end <= 800").groupBy("vehicle_id").agg(F.first("market").alias("market"), (F.first("cohort") == "failed").cast("int").alias("label"), F.round(F.avg("level_end"), 6).alias("score"))
    return M.roc_auc(x, ["market"]).select("market", _r("auc", 6), (F.col("n_pos") * F.col("n_neg")).alias("pairs"))


@query("m22_leads_report", "SELECT count(*) AS n_alerts, round(avg(CASE WHEN alert_odo=first_cut THEN 1.0::DOUBLE ELSE 0 END),6) AS first_cut_share, round(quantile_cont((alert_odo-first_cut)/nullif(last_cut-first_cut,0),0.5),6) AS position_p50 FROM (SELECT vehicle_id, min(cut_odo) AS alert_odo FROM runs WHERE run_min>=0.5 GROUP BY 1) JOIN (SELECT vehicle_id, min(cut_odo) AS first_cut, max(cut_odo) AS last_cut FROM scores GROUP BY 1) USING (vehicle_id)")
def m22(f):
    e = f.scores.groupBy("vehicle_id").agg(F.min("cut_odo").alias("a"), F.max("cut_odo").alias("b"))
    x = M.first_alerts(f.scores, 0.5, K).join(e, "vehicle_id")
    place = (F.col("alert_odo") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    facts = [F.count("*").alias("n_alerts"), F.round(F.avg((F.col("alert_odo") == F.col("a")).cast("double")), 6).alias("first_cut_share")]
    return quantiles(x, [], [("position_p50", place, 0.5)], facts).withColumn("position_p50", F.round("position_p50", 6))


@query("m23_cell_rate_floor", f"WITH x AS (SELECT *, vehicle_id%5 AS fold FROM {SM}) SELECT market, fold, round(coalesce(o.y/nullif(o.n,0)::DOUBLE, t.y/t.n::DOUBLE),6) AS rate, c.n FROM (SELECT market, fold, count(*) AS n FROM x GROUP BY ALL) c JOIN (SELECT a.market, a.fold, sum(b.label) AS y, count(b.label) AS n FROM (SELECT DISTINCT market, fold FROM x) a LEFT JOIN x b ON a.market=b.market AND a.fold<>b.fold GROUP BY ALL) o USING (market, fold) JOIN (SELECT a.fold, sum(b.label) AS y, count(*) AS n FROM (SELECT DISTINCT fold FROM x) a JOIN x b ON a.fold<>b.fold GROUP BY 1) t USING (fold)")
def m23(f):
    x = M.out_of_fold_rate(with_market(f).withColumn("fold", F.col("vehicle_id") % 5), ["market"], "fold")
    return x.groupBy("market", "fold").agg(F.round(F.first("rate"), 6).alias("rate"), F.count("*").alias("n"))


@query("m24_out_of_fold_threshold", """WITH l AS (SELECT *, vehicle_id%5 AS fold FROM levels), h AS (SELECT unnest(range(0,5)) AS held), o AS (SELECT held, level FROM h JOIN l ON fold<>held WHERE event_observed=0),
  n AS (SELECT held, CAST(floor(0.1::DOUBLE*count(*)+1e-9) AS BIGINT) AS m FROM o GROUP BY 1), r AS (SELECT held, level, row_number() OVER (PARTITION BY held ORDER BY level DESC) AS k FROM o WHERE level IS NOT NULL), t AS (SELECT n.held AS fold, level AS tau FROM n LEFT JOIN r ON r.held=n.held AND r.k=n.m+1),
  x AS (SELECT fold, event_observed, CASE WHEN level>coalesce(tau,'-inf'::DOUBLE) THEN 1.0::DOUBLE ELSE 0 END AS hit FROM l JOIN t USING (fold)) SELECT CAST(fold AS BIGINT) AS fold, 0.1::DOUBLE AS budget, round(avg(CASE WHEN event_observed=1 THEN hit END),6) AS detection, round(avg(CASE WHEN event_observed=0 THEN hit END),6) AS false_alarms FROM x GROUP BY 1""")
def m24(f):
    """tau of each fold from the healthy vehicles of the others, applied to the fold."""
    lv = M.vehicle_levels(f.scores, K).withColumn("fold", F.col("vehicle_id") % 5)
    others = lv.withColumn("held", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(5))))).filter("held <> fold")
    t = M.exact_tau(others, [0.1], ["held"]).withColumnRenamed("held", "fold")
    return M.detection(lv, t, ["fold"]).select("fold", "budget", _r("detection", 6), _r("false_alarms", 6))


@query("m25_win_lose_tie", f"WITH a AS (SELECT 'a' AS run, repeat, auc FROM {auc_sql('rep', 'repeat')} UNION ALL SELECT 'b', repeat, 1-auc FROM {auc_sql('rep', 'repeat')}), g AS (SELECT run, avg(auc) AS m, stddev_pop(auc) AS s FROM a GROUP BY 1) SELECT g.run, round(g.m,6) AS mean, round(g.m-r.m,6) AS diff, CASE WHEN g.m-r.m>sqrt((pow(g.s,2)+pow(r.s,2))/2) THEN 'win' WHEN g.m-r.m< -sqrt((pow(g.s,2)+pow(r.s,2))/2) THEN 'lose' ELSE 'tie' END AS verdict FROM g CROSS JOIN (SELECT * FROM g WHERE run='a') r")
def m25(f):
    a = M.roc_auc(repeated(f), ["repeat"]).select("repeat", "auc")
    x = a.withColumn("run", F.lit("a")).unionByName(a.withColumns({"run": F.lit("b"), "auc": 1 - F.col("auc")}))
    return M.verdicts(x, "run", "auc", "a").select("run", _r("mean", 6), _r("diff", 6), "verdict")


@query("m27_univariate_screening", " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, (SELECT round(auc,6) FROM {auc_sql('scores', score=m)}) AS auc FROM scores" for m in ("score", "cut_odo", "km_after")))
def m27(f):
    u = P.unpivot(f.scores, ["label"], ["score", "cut_odo", "km_after"])
    return M.roc_auc(u, ["metric"], score="value").select("metric", (F.col("n_pos") + F.col("n_neg")).alias("n"), _r("auc", 6))


@query("m28_metrics_by_repeat", f"SELECT a.repeat, round(auc,6) AS auc, round(ap,6) AS ap FROM {auc_sql('rep', 'repeat')} a JOIN {ap_sql('rep', 'repeat')} b USING (repeat)")
def m28(f):
    r = repeated(f)
    return M.roc_auc(r, ["repeat"]).join(M.average_precision(r, ["repeat"]), "repeat").select("repeat", _r("auc", 6), _r("ap", 6))


@query("m29_cost_optimal_class", "SELECT truth, hat, count(*) AS n FROM (SELECT label AS truth, CASE WHEN (1-score)*0+score*10 <= (1-score)*1+score*0 THEN 0 ELSE 1 END AS hat FROM scores) GROUP BY ALL")
def m29(f):
    cost = f.spark.createDataFrame([(0, 0.0, 10.0), (1, 1.0, 0.0)], "hat int, c0 double, c1 double")
    x = f.scores.crossJoin(F.broadcast(cost)).withColumn("c", (1 - F.col("score")) * F.col("c0") + F.col("score") * F.col("c1"))  # two rows
    x = x.groupBy("vehicle_id", "cut_odo").agg(F.first("label").alias("truth"), F.min(F.struct("c", "hat")).alias("b"))
    return x.groupBy("truth", F.col("b.hat").alias("hat")).agg(F.count("*").alias("n"))


@query("m30_floors", f"SELECT 'production' AS floor, round(auc,6) AS auc FROM {auc_sql('(SELECT label, -production_day AS score FROM scores JOIN vehicles USING (vehicle_id))')} UNION ALL SELECT 'usage', round(auc,6) FROM {auc_sql('(SELECT label, -km_after AS score FROM scores)')}")
def m30(f):
    x = f.scores.join(f.vehicles.select("vehicle_id", "production_day"), "vehicle_id").select("label", (-F.col("production_day")).alias("production"), (-F.col("km_after")).alias("usage"))
    return M.roc_auc(P.unpivot(x, ["label"], ["production", "usage"], "floor"), ["floor"], score="value").select("floor", _r("auc", 6))


@query("m31_position_diagnostics", f"SELECT (SELECT round(auc,6) FROM {auc_sql('(SELECT * FROM scores WHERE cut_odo<=1500)')}) AS early_auc, (SELECT round(corr(x,y),6) FROM (SELECT rank() OVER (ORDER BY s)+(count(*) OVER (PARTITION BY s)-1)/2.0::DOUBLE AS x, rank() OVER (ORDER BY c)+(count(*) OVER (PARTITION BY c)-1)/2.0::DOUBLE AS y FROM (SELECT round(avg(score),6) AS s, round(avg(cut_odo),6) AS c FROM scores GROUP BY vehicle_id))) AS vehicle_rho")
def m31(f):
    a = M.roc_auc(f.scores.filter("cut_odo <= 1500")).select(F.round("auc", 6).alias("early_auc"))
    v = f.scores.groupBy("vehicle_id").agg(F.round(F.avg("score"), 6).alias("s"), F.round(F.avg("cut_odo"), 6).alias("c"))
    return a.crossJoin(P.ranked_corr(v, "s", "c").select(F.round("rho", 6).alias("vehicle_rho")))  # one row each


@query("m32_positional_floor", f"SELECT 'position' AS run, round(auc,6) AS auc FROM {auc_sql('(SELECT label, cut_odo AS score FROM scores)')} UNION ALL SELECT 'score', round(auc,6) FROM {auc_sql('scores')}")
def m32(f):
    x = f.scores.select("label", F.col("cut_odo").alias("position"), "score")
    return M.roc_auc(P.unpivot(x, ["label"], ["position", "score"], "run"), ["run"], score="value").select("run", _r("auc", 6))


@query("m33_external_index_gate", f"SELECT market, round(auc,6) AS auc FROM {auc_sql('(SELECT market, CASE WHEN cohort=$$failed$$ THEN 1 ELSE 0 END AS label, -acctbal AS score FROM vehicles)', 'market')}")
def m33(f):
    x = f.vehicles.select("market", (F.col("cohort") == "failed").cast("int").alias("label"), (-F.col("acctbal")).alias("score"))
    return M.roc_auc(x, ["market"]).select("market", _r("auc", 6))


@query("m34_channel_ranking", " UNION ALL ".join(f"SELECT '{c}' AS channel, round(a.auc,6) AS auc, round(b.ap,6) AS ap FROM {auc_sql(f'(SELECT label, {c} AS score FROM (SELECT vehicle_id, cut_odo, label, round(avg(level_end),6) AS level, round(avg(value),6) AS value FROM win GROUP BY ALL))')} a CROSS JOIN {ap_sql(f'(SELECT label, {c} AS score FROM (SELECT vehicle_id, cut_odo, label, round(avg(level_end),6) AS level, round(avg(value),6) AS value FROM win GROUP BY ALL))')} b" for c in ("level", "value")))
def m34(f):
    x = f.windowed.groupBy("vehicle_id", "cut_odo", "label").agg(F.round(F.avg("level_end"), 6).alias("level"), F.round(F.avg("value"), 6).alias("value"))
    u = P.unpivot(x, ["label"], ["level", "value"], "channel", "score")
    return M.roc_auc(u, ["channel"]).join(M.average_precision(u, ["channel"]), "channel").select("channel", _r("auc", 6), _r("ap", 6))


# Splits


def strata(f):
    return splits.composite_strata(f.vehicles, ["market", "engine", "cohort"], 15)


STRATA = "(SELECT vehicle_id, market, cohort, CASE WHEN count(*) OVER (PARTITION BY market,engine,cohort)>=15 THEN market||'|'||engine||'|'||cohort WHEN count(*) OVER (PARTITION BY market,engine)>=15 THEN market||'|'||engine WHEN count(*) OVER (PARTITION BY market)>=15 THEN CAST(market AS VARCHAR) ELSE 'all' END AS stratum FROM vehicles)"
FOLDS = f"(SELECT repeat, CAST((row_number() OVER (PARTITION BY repeat, stratum ORDER BY md5('11|'||repeat||'|'||vehicle_id), vehicle_id)-1)%5 AS INTEGER) AS fold, vehicle_id FROM (SELECT vehicle_id, stratum, unnest([0,1]) AS repeat FROM {STRATA}))"


@query("x01_composite_strata", f"SELECT stratum, count(*) AS n FROM {STRATA} GROUP BY 1")
def x01(f):
    return strata(f).groupBy("stratum").agg(F.count("*").alias("n"))


@query("x02_stratify_by_vehicle", "SELECT vehicle_id, max(label) AS stratum, count(DISTINCT label) AS n_values FROM cuts GROUP BY 1")
def x02(f):
    return splits.stratify(f.cuts, "label")


@query("x03_grouped_stratified_folds", f"SELECT * FROM {FOLDS}")
def x03(f):
    return splits.folds(strata(f), 5, 2, 11)


@query("x04_extended_folds", f"""WITH s AS (SELECT vehicle_id, stratum, unnest([0,1]) AS repeat FROM {STRATA}), o AS (SELECT repeat, stratum, vehicle_id, CAST((row_number() OVER (PARTITION BY repeat, stratum ORDER BY md5('11|'||repeat||'|'||vehicle_id), vehicle_id)-1)%5 AS INTEGER) AS fold FROM s WHERE vehicle_id%4<>0),
  new AS (SELECT repeat, stratum, vehicle_id, row_number() OVER (PARTITION BY repeat, stratum ORDER BY md5('13|'||repeat||'|'||vehicle_id), vehicle_id) AS j FROM s WHERE vehicle_id%4=0), need AS (SELECT repeat, stratum, count(*) AS m FROM new GROUP BY ALL),
  full_ AS (SELECT repeat, stratum, f.fold, m, (SELECT count(*) FROM o WHERE o.repeat=need.repeat AND o.stratum=need.stratum AND o.fold=f.fold) AS n FROM need CROSS JOIN (SELECT CAST(unnest(range(0,5)) AS INTEGER) AS fold) f), lv AS (SELECT repeat, stratum, fold, unnest(generate_series(n, n+m-1)) AS lvl FROM full_),
  seats AS (SELECT repeat, stratum, fold, row_number() OVER (PARTITION BY repeat, stratum ORDER BY lvl, fold) AS j FROM lv) SELECT repeat, fold, vehicle_id FROM o UNION ALL SELECT repeat, fold, vehicle_id FROM new JOIN seats USING (repeat, stratum, j)""")
def x04(f):
    old = splits.folds(strata(f).filter("vehicle_id % 4 <> 0"), 5, 2, 11)
    return splits.extend_folds(old, strata(f), 5, 13)


SIDES = f"(SELECT vehicle_id, CASE WHEN fold=0 THEN 'test' ELSE 'dev' END AS side FROM {FOLDS} WHERE repeat=0)"


@query("x05_holdout", f"SELECT * FROM {SIDES}")
def x05(f):
    return splits.holdout(strata(f), 5, 11)


@query("x06_restricted_holdout", f"SELECT vehicle_id, CASE WHEN vehicle_id IN (SELECT vehicle_id FROM trips) THEN side ELSE 'excluded' END AS side FROM {SIDES}")
def x06(f):
    return splits.restrict(splits.holdout(strata(f), 5, 11), f.trips)


@query("x07_extended_holdout", f"SELECT vehicle_id, CASE WHEN (row_number() OVER (PARTITION BY vehicle_id%3=1, stratum ORDER BY md5(CASE WHEN vehicle_id%3=1 THEN '12' ELSE '11' END||'|0|'||vehicle_id), vehicle_id)-1)%5=0 THEN 'test' ELSE 'dev' END AS side FROM {STRATA}")
def x07(f):
    first = splits.holdout(strata(f).filter("vehicle_id % 3 <> 1"), 5, 11)
    return splits.extend_holdout(first, strata(f), 5, 12)


@query("x08_sides_applied", f"SELECT coalesce(side,'unknown') AS side, count(*) AS n FROM cuts LEFT JOIN (SELECT * FROM {SIDES} WHERE vehicle_id%13<>0) USING (vehicle_id) GROUP BY 1")
def x08(f):
    s = splits.holdout(strata(f), 5, 11).filter("vehicle_id % 13 <> 0")
    return splits.apply_sides(f.cuts, s).groupBy("side").agg(F.count("*").alias("n"))


@query("x09_panel_fingerprint", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(v) AS BIGINT) AS n_vehicles, sha256(string_agg(d, ',' ORDER BY block)) AS digest FROM (SELECT vehicle_id//4096 AS block, sum(n) AS n, count(*) AS v, sha256(string_agg(CAST(vehicle_id AS VARCHAR), ',' ORDER BY vehicle_id)) AS d FROM (SELECT vehicle_id, count(*) AS n FROM trips GROUP BY 1) GROUP BY 1)")
def x09(f):
    return splits.fingerprint(f.trips)


@query("x10_reproduced_split", f"SELECT n_rows, n_vehicles, digest, unnest(['frozen','again']) AS which FROM (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_vehicles, sha256(string_agg(d, ',' ORDER BY block)) AS digest FROM (SELECT vehicle_id//4096 AS block, count(*) AS n, sha256(string_agg(CAST(vehicle_id AS VARCHAR), ',' ORDER BY vehicle_id)) AS d FROM {SIDES} WHERE side='test' GROUP BY 1))")
def x10(f):
    a, b = splits.holdout(strata(f), 5, 11), splits.holdout(strata(f).repartition("engine"), 5, 11)
    d = lambda x: splits.fingerprint(x.filter("side = 'test'"))
    return d(a).withColumn("which", F.lit("frozen")).unionByName(d(b).withColumn("which", F.lit("again")))


@query("x11_random_cut_per_healthy_vehicle", "SELECT vehicle_id, cut_odo FROM cuts WHERE event_observed=0 QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY md5('5|'||vehicle_id||'|'||CAST(cut_odo AS BIGINT)), cut_odo)=1")
def x11(f):
    w = Window.partitionBy("vehicle_id").orderBy(splits.draw(5, F.col("vehicle_id"), F.col("cut_odo").cast("bigint")), "cut_odo")
    return f.cuts.filter("event_observed = 0").withColumn("k", F.row_number().over(w)).filter("k = 1").select("vehicle_id", "cut_odo")


@query("x12_fold_table", f"SELECT repeat, fold, count(*) AS vehicles, count(*) FILTER (vehicle_id%3=0) AS failed FROM {FOLDS} GROUP BY ALL")
def x12(f):
    return splits.folds(strata(f), 5, 2, 11).groupBy("repeat", "fold").agg(F.count("*").alias("vehicles"), F.count_if(F.col("vehicle_id") % 3 == 0).alias("failed"))


@query("x12b_same_folds", "SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b")
def x12b(f):
    a = splits.folds(strata(f), 5, 2, 11)
    return splits.same_folds(a, splits.folds(strata(f).repartition("market"), 5, 2, 11))


# Explanations

ALERTS = "(SELECT vehicle_id, min(cut_odo) AS alert_odo FROM runs WHERE run_min>=0.5 GROUP BY 1)"
FEATS = ["level", "value", "idle", "severe"]
CONTRIB = """(SELECT vehicle_id, feature, round(v,6) AS phi FROM (UNPIVOT (SELECT vehicle_id, avg(level_end)/100-0.5 AS level, (avg(value)-50)/100 AS value, avg(CASE WHEN trip_km<=0 THEN 1.0::DOUBLE ELSE 0 END)-0.2 AS idle, avg(CASE WHEN message='error' THEN 1.0::DOUBLE ELSE 0 END)-0.2 AS severe FROM trips GROUP BY 1) ON level, value, idle, severe INTO NAME feature VALUE v))"""


def contributions(f, rows=None):
    """Additive contributions of an index of four features, one row per vehicle and feature."""
    t = f.trips if rows is None else rows
    x = t.groupBy("vehicle_id").agg((F.avg("level_end") / 100 - 0.5).alias("level"), ((F.avg("value") - 50) / 100).alias("value"), (F.avg((F.col("trip_km") <= 0).cast("double")) - 0.2).alias("idle"), (F.avg((F.col("message") == "error").cast("double")) - 0.2).alias("severe"))
    return explain.long_contributions(x, FEATS).withColumn("phi", F.round("phi", 6))


@query("e01_vehicle_alerts", f"SELECT v.vehicle_id, event_observed, top_score, alert_odo, CASE WHEN event_observed=1 THEN CASE WHEN alert_odo IS NULL THEN 'missed' ELSE 'detected' END WHEN alert_odo IS NULL THEN 'quiet' ELSE 'false_alarm' END AS outcome FROM (SELECT vehicle_id, max(event_observed) AS event_observed, max(score) AS top_score FROM scores GROUP BY 1) v LEFT JOIN {ALERTS} a ON a.vehicle_id=v.vehicle_id")
def e01(f):
    return explain.vehicle_alerts(f.scores, 0.5, K).select("vehicle_id", "event_observed", "top_score", "alert_odo", "outcome")


EXPL = f"(SELECT s.vehicle_id, cut_odo, score, alert_odo IS NOT NULL AS alerted FROM scores s LEFT JOIN {ALERTS} a ON a.vehicle_id=s.vehicle_id QUALIFY (alert_odo IS NOT NULL AND cut_odo>=alert_odo AND sum(CASE WHEN cut_odo>=alert_odo THEN 1 ELSE 0 END) OVER (PARTITION BY s.vehicle_id ORDER BY cut_odo)<=2) OR (alert_odo IS NULL AND row_number() OVER (PARTITION BY s.vehicle_id ORDER BY score DESC, cut_odo)=1))"


@query("e02_explained_cuts", f"SELECT *, CASE WHEN score>=0.55 THEN 'high' WHEN score>=0.45 THEN 'medium' ELSE 'low' END AS risk FROM {EXPL}")
def e02(f):
    return explain.explained_cuts(f.scores, 0.5, K)


@query("e03_means_over_explained_cuts", f"SELECT x.vehicle_id, round(avg(s.km_after),4) AS km_after, round(avg(s.score)+1e-9,6) AS score FROM {EXPL} x JOIN scores s USING (vehicle_id, cut_odo) GROUP BY 1")
def e03(f):
    return explain.vehicle_means(explain.explained_cuts(f.scores, 0.5, K).select("vehicle_id", "cut_odo"), f.scores, ["km_after", "score"]).select("vehicle_id", _r("km_after"), F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("e04_family_sums", f"SELECT vehicle_id, CASE feature WHEN 'level' THEN 'filter' WHEN 'severe' THEN 'filter' WHEN 'value' THEN 'usage' ELSE 'other' END AS family, round(sum(phi),6) AS phi FROM {CONTRIB} GROUP BY ALL")
def e04(f):
    return explain.family_sums(contributions(f), {"level": "filter", "severe": "filter", "value": "usage"}).select("vehicle_id", "family", _r("phi", 6))


TOPK = f"(SELECT vehicle_id, feature, phi, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY phi DESC, feature) AS INTEGER) AS rank FROM {CONTRIB} WHERE phi>0 QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY phi DESC, feature)<=2)"


@query("e05_top_contributors", f"SELECT * FROM {TOPK}")
def e05(f):
    return explain.top_contributors(contributions(f), 2)


HALVES = [CONTRIB.replace("FROM trips", f"FROM trips WHERE event_id%2={h}") for h in (0, 1)]
TOPS = [f"(SELECT vehicle_id, list(feature) AS s FROM (SELECT vehicle_id, feature FROM {h} WHERE phi>0 QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY phi DESC, feature)<=2) GROUP BY 1)" for h in HALVES]


@query("e05b_contributor_stability", f"SELECT vehicle_id, CASE WHEN len(list_distinct(list_concat(coalesce(a.s,[]),coalesce(b.s,[]))))>0 THEN len(list_intersect(coalesce(a.s,[]),coalesce(b.s,[])))/len(list_distinct(list_concat(coalesce(a.s,[]),coalesce(b.s,[]))))::DOUBLE ELSE 1.0::DOUBLE END AS jaccard, sign_agreement FROM (SELECT x.vehicle_id, avg(CASE WHEN sign(x.phi)=sign(y.phi) THEN 1.0::DOUBLE ELSE 0 END) AS sign_agreement FROM {HALVES[0]} x JOIN {HALVES[1]} y ON x.vehicle_id=y.vehicle_id AND x.feature=y.feature GROUP BY 1) LEFT JOIN {TOPS[0]} a USING (vehicle_id) LEFT JOIN {TOPS[1]} b USING (vehicle_id)")
def e05b(f):
    return explain.stability(contributions(f, f.trips.filter("event_id % 2 = 0")), contributions(f, f.trips.filter("event_id % 2 = 1")), 2)


@query("e06_plausibility", f"SELECT feature, round(rho,6) AS rho, CASE WHEN feature='idle' THEN 'free' WHEN abs(rho)<0.05 THEN 'flat' WHEN sign(rho)=1 THEN 'plausible' ELSE 'against' END AS verdict FROM (SELECT feature, corr(a,b) AS rho FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY phi)+(count(*) OVER (PARTITION BY feature,phi)-1)/2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature ORDER BY score)+(count(*) OVER (PARTITION BY feature,score)-1)/2.0::DOUBLE AS b FROM {CONTRIB} JOIN (SELECT vehicle_id, max(score) AS score FROM scores GROUP BY 1) USING (vehicle_id)) GROUP BY 1)")
def e06(f):
    x = contributions(f).join(f.scores.groupBy("vehicle_id").agg(F.max("score").alias("score")), "vehicle_id")
    x = joins.average_rank(joins.average_rank(x, "phi", "a", ["feature"]), "score", "b", ["feature"])
    return explain.plausibility(x.groupBy("feature").agg(F.corr("a", "b").alias("rho")), {"level": 1, "value": 1, "severe": 1}).select("feature", _r("rho", 6), "verdict")


@query("e07_message_factors", f"SELECT vehicle_id, feature, phi, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY phi DESC, feature) AS INTEGER) AS rank FROM {CONTRIB} WHERE phi>=0.02 AND feature IN ('level','severe','idle') QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY phi DESC, feature)<=3")
def e07(f):
    return explain.message_factors(contributions(f), 0.02, ["level", "severe", "idle"])


@query("e08_waterfall", f"SELECT vehicle_id, CASE WHEN feature='idle' THEN 'context' WHEN r<=2 THEN feature ELSE 'rest' END AS step, round(sum(phi),6) AS phi FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, feature='idle' ORDER BY abs(phi) DESC, feature) AS r FROM {CONTRIB}) GROUP BY ALL")
def e08(f):
    return explain.waterfall(contributions(f), 2, ["idle"]).select("vehicle_id", "step", _r("phi", 6))


@query("e09_horizon_weeks", "SELECT vehicle_id, greatest(1.0::DOUBLE, round_even(800/(km/days)/7,0)) AS weeks FROM (SELECT vehicle_id, sum(km_c)/100.0::DOUBLE AS km, greatest((epoch_us(max(t_end))-epoch_us(min(t_start)))/86400000000.0::DOUBLE,1.0) AS days FROM trips GROUP BY 1)")
def e09(f):
    from ..plans.panel import days_covered

    x = f.trips.groupBy("vehicle_id").agg((F.sum("km_c") / 100.0).alias("km"), days_covered().alias("days"))
    return x.select("vehicle_id", explain.horizon_weeks(F.lit(800.0), F.col("km") / F.col("days")).alias("weeks"))


REPDET = "(WITH l AS (SELECT repeat, vehicle_id, max(event_observed) AS event_observed, max(run_min) AS level FROM (SELECT *, CASE WHEN count(*) OVER w=2 THEN min(score) OVER w END AS run_min FROM rep WINDOW w AS (PARTITION BY repeat, vehicle_id ORDER BY cut_odo ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) GROUP BY ALL), n AS (SELECT repeat, CAST(floor(0.2::DOUBLE*count(*)+1e-9) AS BIGINT) AS m FROM l WHERE event_observed=0 GROUP BY 1), t AS (SELECT repeat, level AS tau FROM (SELECT repeat, level, row_number() OVER (PARTITION BY repeat ORDER BY level DESC) AS k FROM l WHERE event_observed=0 AND level IS NOT NULL) JOIN n USING (repeat) WHERE k=m+1) SELECT repeat, avg(CASE WHEN event_observed=1 THEN CASE WHEN level>tau THEN 1.0::DOUBLE ELSE 0 END END) AS detection FROM l JOIN t USING (repeat) GROUP BY 1)"


def repeat_detection(f):
    r = repeated(f)
    w = Window.partitionBy("repeat", "vehicle_id").orderBy("cut_odo").rowsBetween(0, K - 1)
    x = r.withColumn("m", F.when(F.count("*").over(w) == K, F.min("score").over(w)))
    lv = x.groupBy("repeat", "vehicle_id").agg(F.max("event_observed").alias("event_observed"), F.max("m").alias("level"))
    return M.detection(lv, M.exact_tau(lv, [0.2], ["repeat"]), ["repeat"])


@query("e12_budget_summary", f"SELECT 0.2::DOUBLE AS budget, round(avg(detection),6) AS detection, round(stddev_pop(detection),6) AS sd, round(avg(detection)-0.2,6) AS excess FROM {REPDET}")
def e12(f):
    return repeat_detection(f).groupBy("budget").agg(F.round(F.avg("detection"), 6).alias("detection"), F.round(F.stddev_pop("detection"), 6).alias("sd"), F.round(F.avg("detection") - 0.2, 6).alias("excess"))


@query("e13_model_comparison", f"SELECT 'level' AS run, round(max(CASE WHEN budget=0.1 THEN detection END),6) AS d10, round(max(CASE WHEN budget=0.2 THEN detection END),6) AS d20, (SELECT round(sum(auc*n_pos*n_neg)/sum(n_pos*n_neg),6) FROM {auc_sql(SM, 'market')}) AS market_auc FROM {DET}")
def e13(f):
    lv = M.vehicle_levels(f.scores, K)
    d = M.detection(lv, M.exact_tau(lv, BUDGETS)).withColumn("run", F.lit("level")).groupBy("run").pivot("budget", [0.1, 0.2]).agg(F.round(F.first("detection"), 6)).toDF("run", "d10", "d20")
    return d.crossJoin(M.stratified_auc(with_market(f), ["market"]).select(F.round("auc", 6).alias("market_auc")))  # one row each


@query("e14_explanation_base_rows", f"SELECT x.vehicle_id, any_value(market) AS market, count(*) AS n_cuts, round(avg(score)+1e-9,6) AS score FROM {EXPL} x JOIN vehicles USING (vehicle_id) GROUP BY 1")
def e14(f):
    x = explain.explained_cuts(f.scores, 0.5, K).join(f.vehicles.select("vehicle_id", "market"), "vehicle_id")
    return x.groupBy("vehicle_id").agg(F.first("market").alias("market"), F.count("*").alias("n_cuts"), F.round(F.avg("score") + 1e-9, 6).alias("score"))
