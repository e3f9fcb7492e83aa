"""Queries of resampling and modelling steps (N, L and the metrics that need them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, resample, splits
from ..operators import metrics as M
from ..operators.quantiles import quantiles
from ..plans import models as L
from ..plans import panel, risk
from ..sources.fleet import SUSTAIN
from .panels import durations
from .derive import MARKERS
from .profile import PD, _r, exposure
from .registry import query
from .scores import SM, auc_sql, repeated, strata, with_market

KEYS = ["vehicle_id", "cut_odo"]
NUM = ["level_mean", "value_mean", "n_trips"]


def model_rows(f):
    """Panel with three features and statics, and a fold by vehicle."""
    x = f.windowed.groupBy(*KEYS, "label", "event_observed", "time_to_event_km", "km_after").agg(F.avg("level_end").alias("level_mean"), F.avg("value").alias("value_mean"), F.count("*").cast("double").alias("n_trips"))
    return x.join(f.vehicles.select("vehicle_id", "market", "engine"), "vehicle_id").withColumn("market", F.col("market").cast("string"))


def model_folds(f, k=3, repeats=1):
    return splits.folds(strata(f), k, repeats, 21)


PERM = "(SELECT a.vehicle_id, a.cut_odo, b.score FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY cut_odo) AS k FROM scores) a JOIN (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY md5('9|'||CAST(cut_odo AS BIGINT)), cut_odo) AS k FROM scores) b ON a.vehicle_id=b.vehicle_id AND a.k=b.k)"


#: Vehicles numbered as resample.bootstrap_weights does, and the weights of its draws.
NUMBERED = "numbered AS (SELECT vehicle_id, row_number() OVER (ORDER BY md5(CAST(vehicle_id AS VARCHAR)), vehicle_id)-1 AS j FROM (SELECT DISTINCT vehicle_id FROM scores))"


def weights_sql(n, seed):
    pick = f"CAST(floor(CAST('0x'||md5('{seed}|'||replicate||'|'||j)[1:12] AS BIGINT)/281474976710656.0::DOUBLE*nv) AS BIGINT)"
    seats = f"(SELECT j, nv, unnest(range(0,{n})) AS replicate FROM numbered CROSS JOIN (SELECT count(*) AS nv FROM numbered))"
    return f"(SELECT CAST(replicate AS INTEGER) AS replicate, v.vehicle_id, count(*) AS weight FROM (SELECT replicate, {pick} AS pick FROM {seats}) d JOIN numbered v ON v.j=d.pick GROUP BY ALL)"


def permuted_sql(src, cols, key, seed, by=""):
    """Rows of src with cols dealt anew over all rows of each group of by; key is the text that names a row."""
    p = f"PARTITION BY {by} " if by else ""
    head = "||'|'||".join([f"'{seed}'", *([c.strip() for c in by.split(",")] if by else [])])
    a = f"(SELECT * EXCLUDE ({cols}), row_number() OVER ({p}ORDER BY md5({key}), {key}) AS k FROM {src})"
    b = f"(SELECT {by + ', ' if by else ''}{cols}, row_number() OVER ({p}ORDER BY md5({head}||'|'||{key}), {key}) AS k FROM {src})"
    return f"(SELECT * EXCLUDE (k) FROM {a} JOIN {b} USING ({by + ', ' if by else ''}k))"


def levels_sql(src, by="g"):
    """Levels of vehicles (greatest score that two cuts in a row sustain) from src with by, vehicle_id, cut_odo, event_observed, score."""
    w = f"(PARTITION BY {by}, vehicle_id ORDER BY cut_odo ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)"
    return f"(SELECT {by}, vehicle_id, max(event_observed) AS event_observed, max(CASE WHEN c=2 THEN r END) AS level FROM (SELECT *, count(*) OVER {w} AS c, min(score) OVER {w} AS r FROM {src}) GROUP BY ALL)"


def detection_sql(src, budget, by="g"):
    """Detection at the exact threshold of a budget, by group, from levels."""
    n = f"(SELECT {by}, CAST(floor({budget}::DOUBLE*count(*)+1e-9) AS BIGINT) AS m FROM {src} WHERE event_observed=0 GROUP BY 1)"
    r = f"(SELECT {by}, level, row_number() OVER (PARTITION BY {by} ORDER BY level DESC) AS k FROM {src} WHERE event_observed=0 AND level IS NOT NULL)"
    tau = f"(SELECT n.{by}, r.level AS tau FROM {n} n LEFT JOIN {r} r ON r.{by}=n.{by} AND r.k=n.m+1)"
    return f"(SELECT {by}, avg(CASE WHEN level>coalesce(tau,'-inf'::DOUBLE) THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_observed=1) AS detection FROM {src} JOIN {tau} USING ({by}) GROUP BY 1)"


CUT = "vehicle_id||'|'||CAST(cut_odo AS BIGINT)"
AT = "vehicle_id||'|'||CAST(cut_odo AS VARCHAR)"


def replicated(n):
    return f"(SELECT vehicle_id, cut_odo, event_observed, score, unnest(range(0,{n})) AS g FROM scores)"


@query("n01_permute_all_rows", f"SELECT vehicle_id, cut_odo, score FROM {permuted_sql('(SELECT vehicle_id, cut_odo, score FROM scores)', 'score', CUT, 9)}")
def n01(f):
    x = f.scores.withColumn("cut", F.col("cut_odo").cast("bigint"))
    return resample.permute(x, ["score"], 9, ["vehicle_id", "cut"]).select("vehicle_id", "cut_odo", "score")


@query("n02_permute_within_vehicle", f"SELECT vehicle_id, cut_odo, score FROM {PERM}")
def n02(f):
    x = f.scores.select("vehicle_id", F.col("cut_odo").cast("bigint").alias("cut"), "cut_odo", "score")
    return resample.permute(x, ["score"], 9, ["cut"], ["vehicle_id"]).select("vehicle_id", "cut_odo", "score")


@query("n03_vehicle_bootstrap_auc", f"WITH {NUMBERED}, h AS (SELECT replicate, score, sum(weight*label)::DOUBLE AS p, sum(weight*(1-label))::DOUBLE AS q FROM scores JOIN {weights_sql(50, 4)} USING (vehicle_id) GROUP BY ALL), c AS (SELECT *, sum(q) OVER (PARTITION BY replicate ORDER BY score)-q AS below FROM h), a AS (SELECT replicate, sum(p*(below+q/2))/nullif(sum(p)*sum(q),0) AS auc FROM c GROUP BY 1) SELECT count(auc) AS n, round(avg(auc),6) AS mean, round(quantile_cont(auc,0.025),6) AS lo, round(quantile_cont(auc,0.975),6) AS hi FROM a")
def n03(f):
    return resample.interval(resample.bootstrap_auc(f.scores, 50, 4), "auc").select("n", _r("mean", 6), _r("lo", 6), _r("hi", 6))


NUMBERED_BY = "numbered AS (SELECT vehicle_id, event_observed, row_number() OVER (PARTITION BY event_observed ORDER BY md5(CAST(vehicle_id AS VARCHAR)), vehicle_id)-1 AS j, count(*) OVER (PARTITION BY event_observed) AS nv FROM la)"
WEIGHTS_BY = "w AS (SELECT replicate, v.vehicle_id, count(*) AS weight FROM (SELECT replicate, event_observed, CAST(floor(CAST('0x'||md5('5|'||replicate||'|'||event_observed||'|'||j)[1:12] AS BIGINT)/281474976710656.0::DOUBLE*nv) AS BIGINT) AS pick FROM (SELECT *, unnest(range(0,40)) AS replicate FROM numbered)) d JOIN numbered v ON v.j=d.pick AND v.event_observed=d.event_observed GROUP BY ALL)"


def weighted_sql(src):
    """Detection at 20 % of the weight of healthy vehicles, by replicate."""
    x = f"(SELECT * FROM {src} JOIN w USING (vehicle_id))"
    m = f"(SELECT replicate, CAST(floor(sum(weight)*0.2::DOUBLE+1e-9) AS BIGINT) AS m FROM {x} WHERE event_observed=0 GROUP BY 1)"
    h = f"(SELECT replicate, level, w1, sum(w1) OVER (PARTITION BY replicate ORDER BY level DESC)-w1 AS above FROM (SELECT replicate, level, sum(weight) AS w1 FROM {x} WHERE event_observed=0 AND level IS NOT NULL GROUP BY 1,2))"
    tau = f"(SELECT replicate, level AS tau FROM {h} JOIN {m} USING (replicate) WHERE above<=m AND above+w1>m)"
    return f"(SELECT replicate, sum(CASE WHEN level>coalesce(tau,'-inf'::DOUBLE) THEN weight ELSE 0 END)/sum(weight)::DOUBLE AS d FROM {x} LEFT JOIN {tau} USING (replicate) WHERE event_observed=1 GROUP BY 1)"


CDF = ", ".join(f"{c!r}::DOUBLE" for c in resample.POISSON)
POISSON_WEIGHTS = f"(SELECT vehicle_id, r, len(list_filter([{CDF}], lambda c: c<=CAST('0x'||md5('29|'||r||'|'||vehicle_id)[1:12] AS BIGINT)/281474976710656.0::DOUBLE)) AS w FROM (SELECT DISTINCT vehicle_id FROM scores) CROSS JOIN (SELECT unnest(range(0,100)) AS r))"


@query("n03b_poisson_bootstrap_auc", f"WITH x AS (SELECT r, score, coalesce(sum(w) FILTER (label=1),0) AS p, coalesce(sum(w) FILTER (label=0),0) AS q FROM scores JOIN {POISSON_WEIGHTS} USING (vehicle_id) GROUP BY ALL), y AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM x) SELECT CAST(r AS INTEGER) AS replicate, round(sum(p*(below+q/2.0::DOUBLE))/nullif(sum(p)*sum(q),0)::DOUBLE,6) AS auc FROM y GROUP BY 1")
def n03b(f):
    """A hundred replicates from one pass over the rows."""
    return resample.poisson_auc(f.scores, 100, 29).select("replicate", _r("auc", 6))


@query("n04_paired_bootstrap", f"WITH la AS (SELECT * FROM {levels_sql('(SELECT *, 0 AS g FROM scores)')}), lb AS (SELECT * FROM {levels_sql('(SELECT * REPLACE (-score AS score), 0 AS g FROM scores)')}), {NUMBERED_BY}, {WEIGHTS_BY}, f AS (SELECT b.d-a.d AS diff FROM {weighted_sql('la')} a JOIN {weighted_sql('lb')} b USING (replicate)) SELECT count(diff) AS n, round(avg(diff),6)+0.0 AS mean, round(quantile_cont(diff,0.025),6)+0.0 AS lo, round(quantile_cont(diff,0.975),6)+0.0 AS hi FROM f")
def n04(f):
    a = M.vehicle_levels(f.scores, SUSTAIN)
    b = M.vehicle_levels(f.scores.withColumn("score", -F.col("score")), SUSTAIN)
    return resample.interval(resample.paired_difference(a, b, 40, 0.2, 5), "diff").select("n", *((F.round(c, 6) + 0.0).alias(c) for c in ("mean", "lo", "hi")))


@query("n05_detection_null", f"WITH p AS (SELECT * FROM {levels_sql(permuted_sql(replicated(30), 'score', AT, 6, 'g'))}), n AS (SELECT detection FROM {detection_sql('p', 0.2)}), l AS (SELECT * FROM {levels_sql('(SELECT *, 0 AS g FROM scores)')}), o AS (SELECT detection FROM {detection_sql('l', 0.2)}) SELECT round(o.detection,6) AS observed, count(*) AS n, round((1+count(*) FILTER (n.detection>=o.detection))/(1+count(*))::DOUBLE,6) AS p FROM n CROSS JOIN o GROUP BY o.detection")
def n05(f):
    null = resample.permutation_levels(f.scores, 30, SUSTAIN, 6).persist()  # read by tau and hits; a row a vehicle and replicate
    d = M.detection(null, M.exact_tau(null, [0.2], ["replicate"]), ["replicate"])
    lv = M.vehicle_levels(f.scores, SUSTAIN)
    return resample.p_value(d, "detection", M.detection(lv, M.exact_tau(lv, [0.2]))).select(_r("observed", 6), "n", _r("p", 6))


@query("n06_bag_size_null", f"WITH p AS (SELECT g, vehicle_id, max(event_observed) AS event_observed, max(score) AS level FROM {permuted_sql(replicated(30), 'score', AT, 8, 'g')} GROUP BY ALL), d AS (SELECT detection FROM {detection_sql('p', 0.2)}) SELECT count(detection) AS n, round(avg(detection),6) AS mean, round(quantile_cont(detection,0.025),6) AS lo, round(quantile_cont(detection,0.975),6) AS hi FROM d")
def n06(f):
    x = resample.replicates(f.scores.select("vehicle_id", "cut_odo", "event_observed", "score"), 30)
    g = resample.permute_replicates(x, 8).groupBy("replicate", "vehicle_id").agg(F.max("event_observed").alias("event_observed"), F.max("score").alias("level")).persist()  # read by tau and hits
    return resample.interval(M.detection(g, M.exact_tau(g, [0.2], ["replicate"]), ["replicate"]), "detection").select("n", _r("mean", 6), _r("lo", 6), _r("hi", 6))


@query("n07_label_permutation_null", f"WITH v AS (SELECT vehicle_id, market, max(event_observed) AS label, round(avg(score)+1e-9,6) AS score FROM {SM} GROUP BY ALL), x AS (SELECT v.*, unnest(range(0,50)) AS replicate FROM v), y AS (SELECT * FROM {permuted_sql('x', 'label', 'CAST(vehicle_id AS VARCHAR)', 7, 'replicate, market')}), n AS (SELECT auc FROM {auc_sql('y', 'replicate')}), o AS (SELECT auc FROM {auc_sql('v')}) SELECT round(o.auc,6) AS observed, count(*) AS n, round((1+count(*) FILTER (n.auc>=o.auc))/(1+count(*))::DOUBLE,6) AS p FROM n CROSS JOIN o GROUP BY o.auc")
def n07(f):
    v = with_market(f).groupBy("vehicle_id", "market").agg(F.max("event_observed").alias("label"), F.round(F.avg("score") + 1e-9, 6).alias("score"))
    x = resample.permute(resample.replicates(v, 50), ["label"], 7, ["vehicle_id"], outer=["replicate", "market"])
    return resample.p_value(M.roc_auc(x, ["replicate"]), "auc", M.roc_auc(v)).select(_r("observed", 6), "n", _r("p", 6))


@query("n08_bootstrap_weights", f"WITH {NUMBERED} SELECT * FROM {weights_sql(20, 3)}")
def n08(f):
    return resample.bootstrap_weights(f.scores, 20, 3)


@query("l01_preprocessed_features")
def l01(f):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    x = model_rows(f)
    out = Pipeline(stages=L.preprocessor(NUM, ["market", "engine"])).fit(x).transform(x)
    return out.select(*KEYS, vector_to_array("features").alias("features"))


@query("l02_grouped_cv")
def l02(f):
    return L.mean_scores(L.run_cv(model_rows(f), model_folds(f), "logistic", NUM, ["market"]))


BASE = "(SELECT *, vehicle_id%5 AS fold FROM scores)"


@query("l03_base_rate_and_random", f"SELECT vehicle_id, cut_odo, base, round(CAST('0x'||md5('19|'||{CUT})[1:12] AS BIGINT)/281474976710656.0::DOUBLE,9) AS random FROM {BASE} JOIN (SELECT a.fold, round(sum(b.label)/count(*)::DOUBLE,6) AS base FROM (SELECT DISTINCT fold FROM {BASE}) a JOIN {BASE} b ON a.fold<>b.fold GROUP BY 1) USING (fold)")
def l03(f):
    x = f.scores.drop("score").withColumn("fold", F.col("vehicle_id") % 5)
    return L.random_scores(L.base_rate_scores(x).withColumnRenamed("score", "base"), 19).select(*KEYS, _r("base", 6), F.round("score", 9).alias("random"))


@query("l04_logistic_l1")
def l04(f):
    return L.run_cv(model_rows(f), model_folds(f), "logistic_l1", NUM)


@query("l05_boosted_trees")
def l05(f):
    return L.final_fit(model_rows(f), model_rows(f), "gbt", NUM)


def stacked(f):
    d = durations(f).join(model_rows(f).select(*KEYS, *NUM), KEYS).persist()  # read by knots, fit and scores; a row a cut
    return d, panel.stack_periods(d, "entry", "duration", "event", 100, 1000)


@query("l06_hazard_stacker")
def l06(f):
    d, s = stacked(f)
    return L.hazard_scores(s, d, NUM, 8)


@query("l07_natural_spline", "SELECT vehicle_id, cut_odo, round(d0-d2,4) AS s1, round(d1-d2,4) AS s2 FROM (SELECT vehicle_id, cut_odo, (pow(greatest(cut_odo-500,0),3)-pow(greatest(cut_odo-3000,0),3))/2500 AS d0, (pow(greatest(cut_odo-1000,0),3)-pow(greatest(cut_odo-3000,0),3))/2000 AS d1, (pow(greatest(cut_odo-2000,0),3)-pow(greatest(cut_odo-3000,0),3))/1000 AS d2 FROM cuts)")
def l07(f):
    _, a, b = L.natural_spline(F.col("cut_odo"), (500.0, 1000.0, 2000.0, 3000.0))
    return f.cuts.select(*KEYS, F.round(a, 4).alias("s1"), F.round(b, 4).alias("s2"))


@query("l08_exposure_stacker")
def l08(f):
    d, _ = stacked(f)
    return L.exposure_scores(panel.stack_exposure(d, "entry", "duration", "event", 100.0, 1000.0), d, NUM, 8, 100.0)


# one factor is saturated: rates, errors of their logarithms and the likelihood have closed forms
RATES = "(SELECT CAST(market AS VARCHAR) AS m, sum(CASE WHEN day=ed THEN 1 ELSE 0 END)::DOUBLE AS e, count(*)::DOUBLE AS d FROM " + PD + " WHERE cohort='failed' GROUP BY 1)"
LOG_LIKELIHOOD = f"(SELECT sum(e*ln(e)-e-lgamma(e+1)) AS ll, count(*) AS k FROM {RATES})"


@query("l09_poisson_rate_table", f"SELECT term, round(exp(b),6) AS rate_ratio, round(exp(b-1.959964*s),6) AS lo, round(exp(b+1.959964*s),6) AS hi, 0.0::DOUBLE AS deviance, round(-2*ll+2*k,6) AS aic FROM (SELECT CASE WHEN r.m=o.m THEN 'intercept' ELSE 'market='||r.m END AS term, CASE WHEN r.m=o.m THEN ln(o.e/o.d) ELSE ln(r.e/r.d)-ln(o.e/o.d) END AS b, CASE WHEN r.m=o.m THEN sqrt(1/o.e) ELSE sqrt(1/r.e+1/o.e) END AS s FROM {RATES} r CROSS JOIN (SELECT * FROM {RATES} ORDER BY m LIMIT 1) o) CROSS JOIN {LOG_LIKELIHOOD}")
def l09(f):
    x = exposure(f).groupBy("market", "cohort").agg(F.sum("is_event").alias("events"), F.count("*").alias("days")).filter("cohort = 'failed'")
    x = L.poisson_table(x, ["market"])
    return x.select("term", *((F.round(c, 6) + 0.0).alias(c) for c in ("rate_ratio", "lo", "hi", "deviance", "aic")))


@query("l09b_likelihood_ratio")
def l09b(f):
    """Markets, then markets and cohorts, against one rate for all."""
    x = exposure(f).groupBy("market", "cohort").agg(F.sum("is_event").alias("events"), F.count("*").alias("days"))
    return L.likelihood_ratio(x, [[], ["market"], ["market", "cohort"]])


@query("l10_ordinal_scores")
def l10(f):
    x = model_rows(f).withColumn("class", risk.ordinal_target((600, 300)).cast("double"))
    return L.ordinal_scores(x, NUM, "class", 4, 1)


@query("l10b_one_vs_rest")
def l10b(f):
    return L.one_vs_rest(model_rows(f).withColumn("class", risk.ordinal_target((600, 300)).cast("double")), NUM, "class")


@query("l11_vehicle_bagging")
def l11(f):
    x = model_rows(f)
    return L.bagged(x, resample.bootstrap_weights(x, 3, 2), "logistic", NUM)


CELLS = "(SELECT vehicle_id, market, strftime(t_start,'%d') AS month, avg(level_end) AS value, count(*)::DOUBLE AS weight, any_value(cohort) AS cohort FROM trips JOIN vehicles USING (vehicle_id) GROUP BY 1,2,3)"


def cells(f):
    x = f.trips.join(f.vehicles.select("vehicle_id", "market", "cohort"), "vehicle_id").withColumn("month", F.date_format("t_start", "dd"))
    return x.groupBy("vehicle_id", "market", "month").agg(F.avg("level_end").alias("value"), F.count("*").cast("double").alias("weight"), F.first("cohort").alias("cohort"))


@query("l12_fleet_reference", f"""WITH c AS (SELECT * FROM {CELLS}), h AS (SELECT * FROM c WHERE cohort='healthy'), a AS (SELECT market, month, quantile_cont(value,0.5) AS ref FROM h GROUP BY ALL HAVING count(*)>=12), b AS (SELECT month, quantile_cont(v,0.5) AS ref FROM (SELECT vehicle_id, month, avg(value) AS v FROM h GROUP BY ALL) GROUP BY 1 HAVING count(*)>=12), g AS (SELECT quantile_cont(v,0.5) AS ref FROM (SELECT vehicle_id, avg(value) AS v FROM h GROUP BY 1))
  SELECT vehicle_id, round(sum((value-coalesce(a.ref,b.ref,g.ref))*weight)/sum(weight),4) AS deviation FROM c LEFT JOIN a USING (market, month) LEFT JOIN b USING (month) CROSS JOIN g GROUP BY 1""")
def l12(f):
    c = cells(f)
    ref = L.FleetReference(12).fit(c.filter("cohort = 'healthy'"), [("cell", ["market", "month"]), ("month", ["month"]), ("all", [])])
    return ref.transform(c).select("vehicle_id", _r("deviation"))


UNIT = "(SELECT vehicle_id, avg(level_end) AS a, avg(value) AS b FROM trips GROUP BY 1)"


@query("l13_unit_weight_index", f"SELECT u.vehicle_id, round((a-ma)/sa-(b-mb)/sb,6) AS index FROM {UNIT} u CROSS JOIN (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM {UNIT} WHERE vehicle_id%5<>0)")
def l13(f):
    x = f.trips.groupBy("vehicle_id").agg(F.avg("level_end").alias("a"), F.avg("value").alias("b"))
    return L.unit_index(x, F.col("vehicle_id") % 5 != 0, {"a": 1, "b": -1}).select("vehicle_id", _r("index", 6))


@query("l14_rank_ensemble", "SELECT vehicle_id, cut_odo, any_value(label) AS label, round(sum(pr*w)/sum(w),6) AS score FROM (SELECT vehicle_id, cut_odo, label, repeat+1 AS w, (rank() OVER (PARTITION BY repeat ORDER BY score)+(count(*) OVER (PARTITION BY repeat, score)-1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY repeat) AS pr FROM rep) GROUP BY 1,2")
def l14(f):
    r = repeated(f)
    return L.rank_ensemble([(r.filter(F.col("repeat") == i), i + 1) for i in range(3)]).select(*KEYS, "label", _r("score", 6))


@query("l15_platt_calibration")
def l15(f):
    x = L.platt(f.scores.withColumn("fold", F.col("vehicle_id") % 3))
    return x.join(M.brier(x.withColumnRenamed("p", "score"), ["fold"]), "fold")


KM = "(SELECT cohort, CASE WHEN event_day IS NULL THEN 55 ELSE event_day-production_day END AS t, CASE WHEN event_day IS NULL THEN 0 ELSE 1 END AS e FROM vehicles)"


def lives(f):
    return f.vehicles.select("market", F.coalesce(F.col("event_day") - F.col("production_day"), F.lit(55)).alias("t"), F.col("event_day").isNotNull().cast("int").alias("e"))


@query("l16_kaplan_meier", "SELECT market, t::DOUBLE AS t, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(exp(sum(ln(1-d/at_risk::DOUBLE)) OVER (PARTITION BY market ORDER BY t)),6) AS survival FROM (SELECT market, t, sum(count(*)) OVER (PARTITION BY market ORDER BY t DESC) AS at_risk, sum(e) AS d FROM (SELECT market, coalesce(event_day-production_day,55) AS t, CASE WHEN event_day IS NULL THEN 0 ELSE 1 END AS e FROM vehicles) GROUP BY market, t) WHERE d>0")
def l16(f):
    return L.kaplan_meier(lives(f), ["market"], "t", "e").withColumn("survival", F.round("survival", 6))


@query("l16c_median_survival", "SELECT market, min(t) FILTER (s<=0.5::DOUBLE+1e-12) AS median FROM (SELECT market, t::DOUBLE AS t, exp(sum(CASE WHEN d<at_risk THEN ln(1-d/at_risk::DOUBLE) ELSE '-inf'::DOUBLE END) OVER (PARTITION BY market ORDER BY t)) AS s FROM (SELECT market, t, sum(count(*)) OVER (PARTITION BY market ORDER BY t DESC) AS at_risk, sum(e) AS d FROM (SELECT market, coalesce(event_day-production_day,55) AS t, CASE WHEN event_day IS NULL THEN 0 ELSE 1 END AS e FROM vehicles) GROUP BY market, t) WHERE d>0) GROUP BY 1")
def l16c(f):
    return L.median_survival(L.kaplan_meier(lives(f), ["market"], "t", "e"), ["market"])


@query("l16b_log_rank", "WITH v AS (SELECT market, coalesce(event_day-production_day,55) AS t, CASE WHEN event_day IS NULL THEN 0 ELSE 1 END AS e FROM vehicles), x AS (SELECT t, sum(e) AS d FROM v GROUP BY 1 HAVING sum(e)>0), r AS (SELECT x.t, d, market, count(*) AS r FROM x JOIN v ON v.t>=x.t GROUP BY ALL), n AS (SELECT t, sum(r) AS n FROM r GROUP BY 1) SELECT market, round(sum(d*r/n::DOUBLE),6) AS expected, (SELECT CAST(sum(e) AS BIGINT) FROM v WHERE v.market=r.market) AS observed FROM r JOIN n USING (t) GROUP BY market")
def l16b(f):
    return L.log_rank(lives(f), "market", "t", "e").withColumn("expected", F.round("expected", 6))


@query("l17_final_fit")
def l17(f):
    """Score of one model of all dev vehicles, and mean score of the fold models."""
    x = model_rows(f).persist()  # a row a cut; four fits read it
    side = splits.holdout(strata(f), 5, 11)
    pick = lambda s: x.join(side.filter(F.col("side") == s), "vehicle_id", "left_semi")
    one = L.final_fit(pick("dev"), pick("test"), "logistic", NUM, ["market"])
    dev = model_folds(f).join(side.filter("side = 'dev'"), "vehicle_id", "left_semi")
    many = L.fold_average(pick("dev"), dev, pick("test"), "logistic", NUM, ["market"])
    return one.join(many.select(*KEYS, F.col("score").alias("score_folds"), F.col("score_std").alias("score_folds_std")), KEYS)


@query("l18_external_incidence")
def l18(f):
    """Fitted on vehicles outside the panel, applied to those inside as it is."""
    x = f.vehicles.join(f.trips.groupBy("vehicle_id").agg(F.count("*").alias("n")), "vehicle_id", "left").select("vehicle_id", F.lit(0.0).alias("cut_odo"), (F.col("cohort") == "failed").cast("int").alias("label"), F.col("market").cast("string").alias("market"), "engine", F.col("acctbal").alias("acctbal"), F.col("days_until_sale").cast("double").alias("sale"))
    inside = f.trips.select("vehicle_id").distinct()
    return L.final_fit(x.join(inside, "vehicle_id", "left_anti"), x.join(inside, "vehicle_id", "left_semi"), "logistic", ["acctbal", "sale"], ["market"]).select("vehicle_id", "label", "score")


@query("m17b_calibration_slope")
def m17b(f):
    return L.calibration_slope(f.scores)


HIT = "avg(CASE WHEN coalesce(d,1e9)<=2 THEN 1.0::DOUBLE ELSE 0 END)"
NEAREST = "(SELECT min(greatest(0, epoch_us(m.a)-x, x-epoch_us(m.b)))/86400000000.0::DOUBLE AS d FROM {0} e LEFT JOIN (SELECT * FROM " + MARKERS + " WHERE marker='long_gap') m USING (vehicle_id) GROUP BY vehicle_id, {1})"
DATED = "(SELECT vehicle_id, epoch_us(event_date) AS x FROM event_dates WHERE vehicle_id IN (SELECT vehicle_id FROM trips))"
DRAWN = f"(SELECT vehicle_id, r, CAST(trunc(a+CAST('0x'||md5('31|'||r||'|'||vehicle_id)[1:12] AS BIGINT)/281474976710656.0::DOUBLE*(b-a)) AS BIGINT) AS x FROM {DATED} JOIN (SELECT vehicle_id, epoch_us(min(t_start)) AS a, epoch_us(max(t_start)) AS b FROM trips GROUP BY 1) USING (vehicle_id) CROSS JOIN (SELECT unnest(range(0,20)) AS r))"


@query("m26_marker_hit_rate", f"SELECT *, CASE WHEN hit_rate>null_rate+0.1::DOUBLE THEN 'informative' ELSE 'no better' END AS verdict FROM (SELECT {HIT} AS hit_rate FROM {NEAREST.format(DATED, 'x')}), (SELECT {HIT} AS null_rate FROM {NEAREST.format(DRAWN, 'x, r')})")
def m26(f):
    """Share of event days within 2 days of a long gap, and of days drawn within the same vehicles."""
    from ..operators import joins

    m = derive.intervention_markers(f.trips).filter("marker = 'long_gap'")
    e = f.event_dates.join(f.trips.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    span = f.trips.groupBy("vehicle_id").agg(F.unix_micros(F.min("t_start")).alias("a"), F.unix_micros(F.max("t_start")).alias("b"))
    draws = resample.replicates(e.select("vehicle_id").join(span, "vehicle_id"), 20)
    null = draws.select("vehicle_id", F.timestamp_micros((F.col("a") + resample.uniform(31, F.col("replicate"), F.col("vehicle_id")) * (F.col("b") - F.col("a"))).cast("long")).alias("at"))
    hit = lambda x: F.avg((F.coalesce(x, F.lit(1e9)) <= 2).cast("double"))
    a = joins.min_distance(e.select("vehicle_id", F.col("event_date").alias("at")), m, "at").agg(hit(F.col("distance_days")).alias("hit_rate"))
    b = joins.min_distance(null, m, "at").agg(hit(F.col("distance_days")).alias("null_rate"))
    return a.crossJoin(b).withColumn("verdict", F.when(F.col("hit_rate") > F.col("null_rate") + 0.1, "informative").otherwise("no better"))  # one row each


def linear_score(c):
    return F.round(0.5 + 0.3 * (F.col("level_mean") - 50) / 50 + 0.2 * (F.col("value_mean") - 50) / 50 + 1e-10, 6)


ROWS = "(SELECT vehicle_id, cut_odo, avg(level_end) AS level_mean, avg(value) AS value_mean FROM win GROUP BY ALL)"


def linear_sql(level, value):
    return f"round(0.5+0.3*({level}-50)/50+0.2*({value}-50)/50+1e-10,6)"


def importance_sql(permuted):
    rows = "(SELECT vehicle_id, cut_odo, event_observed, avg(level_end) AS level_mean, avg(value) AS value_mean FROM win GROUP BY ALL)"
    src = rows if permuted == "none" else permuted_sql(rows, permuted, CUT, 17)
    scored = f"(SELECT vehicle_id, cut_odo, event_observed, {linear_sql('level_mean', 'value_mean')} AS score, 0 AS g FROM {src})"
    return f"SELECT '{permuted}' AS permuted, 0.2::DOUBLE AS budget, round(detection,6) AS detection FROM {detection_sql(levels_sql(scored), 0.2)}"


@query("e10_permutation_importance", " UNION ALL ".join(importance_sql(c) for c in ("none", "level_mean", "value_mean")))
def e10(f):
    """Loss of detection when a channel is permuted over all rows."""
    x = model_rows(f).select(*KEYS, "event_observed", *NUM[:2], F.col("cut_odo").cast("bigint").alias("cut")).persist()  # read by each permutation; a row a cut
    out = None
    for c in (None, "level_mean", "value_mean"):
        y = x if c is None else resample.permute(x, [c], 17, ["vehicle_id", "cut"])
        lv = M.vehicle_levels(y.withColumn("score", linear_score(None)), SUSTAIN).persist()  # read by tau and hits; a row a vehicle
        d = M.detection(lv, M.exact_tau(lv, [0.2])).select(F.lit(c or "none").alias("permuted"), "budget", _r("detection", 6))
        out = d if out is None else out.unionByName(d)
    return out


@query("e11_erasure_test", f"WITH x AS (SELECT * FROM {ROWS}), m AS (SELECT quantile_cont(level_mean,0.5) AS l, quantile_cont(value_mean,0.5) AS v FROM x), d AS (SELECT unnest(['level_mean','value_mean']) AS erased, unnest([{linear_sql('level_mean', 'value_mean')}-{linear_sql('l', 'value_mean')}, {linear_sql('level_mean', 'value_mean')}-{linear_sql('level_mean', 'v')}]) AS drop_ FROM x CROSS JOIN m) SELECT erased, count(*) AS n, round(avg(drop_),5) AS mean_drop, round(avg(abs(drop_)),5) AS mean_change FROM d GROUP BY 1")
def e11(f):
    """Score drop of vehicles when a feature is set to its median, against the other."""
    x = model_rows(f)
    med = quantiles(x, [], [(f"_{c}", c, 0.5) for c in NUM[:2]])
    y = x.crossJoin(F.broadcast(med)).withColumn("score", linear_score(None)).withColumn("erased", F.explode(F.array(F.lit("level_mean"), F.lit("value_mean"))))  # one row
    for c in NUM[:2]:
        y = y.withColumn(c, F.when(F.col("erased") == c, F.col(f"_{c}")).otherwise(F.col(c)))
    return y.withColumn("drop", F.col("score") - linear_score(None)).groupBy("erased").agg(F.count("*").alias("n"), F.round(F.avg("drop"), 5).alias("mean_drop"), F.round(F.avg(F.abs("drop")), 5).alias("mean_change"))
