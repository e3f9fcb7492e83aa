"""Ranking and alert metrics as DataFrame queries.

Rank metrics work on histograms of distinct scores with running counts (operators.joins.running_counts), so no group is sorted in one task.
Alert metrics reduce each vehicle to its level, the greatest score that k consecutive cuts sustain, before thresholds come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import comparable_pairs, running_counts
from .quantiles import quantiles

KEY, AT = "vehicle_id", "cut_odo"


def histogram_of(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(by, s, p, n) with running counts: positives and negatives of each distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    h = rows.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("n"))
    return running_counts(h, by, "s", ["p", "n"])


def roc_auc(rows: DataFrame, by: list[str] = (), **names) -> DataFrame:
    """auc (ties count half) with n_pos and n_neg; null without both kinds."""
    by = list(by)
    h = histogram_of(rows, by, **names)
    g = h.groupBy(*by).agg(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)).alias("u"), F.max("p_all").alias("n_pos"), F.max("n_all").alias("n_neg"))
    return g.select(*by, F.try_divide("u", F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def average_precision(rows: DataFrame, by: list[str] = (), **names) -> DataFrame:
    """ap by the step sum over distinct scores, base rate and lift."""
    by = list(by)
    h = histogram_of(rows, by, **names)
    tp, fp = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    g = h.groupBy(*by).agg(F.sum(F.try_divide("p", "p_all") * (tp / (tp + fp))).alias("ap"), F.max("p_all").alias("_p"), F.max("n_all").alias("_n"))
    base = F.col("_p") / (F.col("_p") + F.col("_n"))
    return g.select(*by, "ap", base.alias("base_rate"), F.try_divide(F.col("ap"), base).alias("lift"))


def brier(rows: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def stratified_auc(rows: DataFrame, stratum: list[str], **names) -> DataFrame:
    """One row: AUC over pairs within the same stratum, and the pairs."""
    a = roc_auc(rows, stratum, **names).withColumn("pairs", F.col("n_pos") * F.col("n_neg"))
    return a.agg((F.sum(F.col("auc") * F.col("pairs")) / F.sum("pairs")).alias("auc"), F.sum("pairs").alias("pairs"))


def within_vehicle_auc(rows: DataFrame) -> DataFrame:
    """One row: mean of the vehicles' own AUCs."""
    return roc_auc(rows, [KEY]).filter("auc is not null").agg(F.avg("auc").alias("auc"), F.count("*").alias("n_vehicles"))


def vehicle_constant(rows: DataFrame, column: str, how=F.max) -> DataFrame:
    """rows with column replaced by its aggregate over the vehicle."""
    return rows.withColumn(column, how(column).over(Window.partitionBy(KEY)))


def sustained(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Each cut that begins k consecutive ones, with their least score as run_min."""
    w = Window.partitionBy(KEY).orderBy(AT).rowsBetween(0, k - 1)
    return rows.withColumns({"run_min": F.min(score).over(w), "_n": F.count("*").over(w)}).filter(F.col("_n") == k).drop("_n")


def first_alerts(rows: DataFrame, tau: Column | float, k: int) -> DataFrame:
    """Per vehicle with an alert: alert_odo, the first of k consecutive cuts with scores >= tau, and its lead (time_to_event_km)."""
    t = tau if isinstance(tau, Column) else F.lit(tau)
    return sustained(rows, k).filter(F.col("run_min") >= t).groupBy(KEY).agg(F.min(AT).alias("alert_odo"), F.min_by("time_to_event_km", AT).alias("lead_km"))


def vehicle_levels(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Per vehicle: level (null with less than k cuts), event_observed. A vehicle alerts at tau exactly if level >= tau."""
    w = Window.partitionBy(KEY).orderBy(AT).rowsBetween(0, k - 1)
    x = rows.withColumn("_m", F.when(F.count("*").over(w) == k, F.min(score).over(w)))
    return x.groupBy(KEY).agg(F.max("event_observed").alias("event_observed"), F.max("_m").alias("level"))


def budget_index(n: Column, alpha: Column) -> Column:
    """Healthy vehicles that may alert under a budget."""
    return F.floor(alpha * n + 1e-9)


def exact_tau(levels: DataFrame, budgets: list[float], by: list[str] = ()) -> DataFrame:
    """Per budget: tau, the healthy level of rank m + 1 from above; an alert is a level strictly above it (null: any level is one)."""
    by = list(by)
    h = levels.filter("event_observed = 0")
    n = h.groupBy(*by).agg(F.count("*").alias("n_healthy"))
    spine = n.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets))))
    spine = spine.withColumn("m", budget_index(F.col("n_healthy"), F.col("budget")))
    # a histogram of levels, so that ranks need no sort of all vehicles
    g = running_counts(h.filter("level is not null").groupBy(*by, "level").agg(F.count("*").alias("w")), by, "level", ["w"])
    above = F.col("w_all") - F.col("w_below") - F.col("w")
    g = g.select(*(F.col(c).alias(f"_{c}") for c in by), "level", above.alias("_above"), "w")
    cond = (F.col("_above") <= F.col("m")) & (F.col("_above") + F.col("w") > F.col("m"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return spine.join(g, cond, "left").select(*by, "budget", "n_healthy", "m", F.col("level").alias("tau"))


def detection(levels: DataFrame, taus: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per budget: share of event vehicles with a level above tau, and of healthy ones (false alarms). taus has a few rows a group."""
    by = list(by)
    x = levels.join(F.broadcast(taus), by) if by else levels.crossJoin(F.broadcast(taus))  # a row a budget
    hit = F.coalesce(F.col("level") > F.coalesce("tau", F.lit(float("-inf"))), F.lit(False)).cast("double")
    return x.groupBy(*by, "budget").agg(F.avg(F.when(F.col("event_observed") == 1, hit)).alias("detection"), F.avg(F.when(F.col("event_observed") == 0, hit)).alias("false_alarms"))


def threshold_curve(rows: DataFrame, taus: list[float], k: int) -> DataFrame:
    """Per tau: detection, false alarms, quartiles of lead and the share of event vehicles that never alert. Runs are found once."""
    runs = sustained(rows, k).select(KEY, AT, "run_min", "time_to_event_km")
    x = runs.withColumn("tau", F.explode(F.array(*(F.lit(t) for t in taus)))).filter("run_min >= tau").groupBy(KEY, "tau").agg(F.min_by("time_to_event_km", AT).alias("lead_km"))
    v = rows.groupBy(KEY).agg(F.max("event_observed").alias("event_observed")).withColumn("tau", F.explode(F.array(*(F.lit(t) for t in taus))))
    y = v.join(x.withColumn("hit", F.lit(1.0)), [KEY, "tau"], "left")
    ev, hit = F.col("event_observed") == 1, F.coalesce("hit", F.lit(0.0))
    facts = [F.avg(F.when(ev, hit)).alias("detection"), F.avg(F.when(~ev, hit)).alias("false_alarms"), (1 - F.avg(F.when(ev, hit))).alias("never")]
    lead = F.when(ev, F.col("lead_km"))
    return quantiles(y, ["tau"], [("lead_q1", lead, 0.25), ("lead_p50", lead, 0.5), ("lead_q3", lead, 0.75)], facts)


def operating_point(curve: DataFrame, budget: float) -> DataFrame:
    """The row of greatest detection among those within the budget; ties to the smaller tau."""
    return curve.filter(F.col("false_alarms") <= budget).orderBy(F.desc("detection"), "tau").limit(1)


def pooled(rows: DataFrame, k: int = 3) -> DataFrame:
    """Vehicle scores: max, mean, mean of the k greatest, and noisy-or."""
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), AT)
    x = rows.withColumn("_k", F.row_number().over(w))
    return x.groupBy(KEY).agg(F.max("label").alias("label"), F.max("event_observed").alias("event_observed"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.avg(F.when(F.col("_k") <= k, F.col("score"))).alias("topk"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(1 - 1e-12)))))).alias("noisy_or"))


def cost_curve(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """Per ratio of the cost of a miss to that of a false alarm: the score threshold of least cost, its cost, and those of alerting all or none."""
    h = histogram_of(rows, [])
    tp, fp = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    x = h.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in ratios))))
    x = x.withColumn("cost", F.col("ratio") * (F.col("p_all") - tp) + fp)
    best = F.min(F.struct("cost", "s"))
    return x.groupBy("ratio").agg(best.alias("b"), F.max(F.col("n_all").cast("double")).alias("cost_all"), F.max(F.col("ratio") * F.col("p_all")).alias("cost_none")).select("ratio", F.col("b.s").alias("tau"), F.col("b.cost").alias("cost"), "cost_all", "cost_none")


def expected_cost(curve: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Optimum per scenario (miss, visit, effectiveness, prevalence) over the curve (tau, detection, false_alarms), with PPV. Both are small."""
    x = curve.crossJoin(F.broadcast(scenarios))  # a row a threshold by a row a scenario
    hit, fa, pi = F.col("detection"), F.col("false_alarms"), F.col("prevalence")
    cost = pi * (1 - hit * F.col("effectiveness")) * F.col("miss") + (pi * hit + (1 - pi) * fa) * F.col("visit")
    x = x.withColumn("cost", cost).withColumn("ppv", F.try_divide(pi * hit, pi * hit + (1 - pi) * fa))
    keys = [c for c in scenarios.columns]
    return x.groupBy(*keys).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "tau", "ppv")).alias("b")).select(*keys, "b.cost", "b.tau", "b.ppv")


def concordance(rows: DataFrame, group: str | None = None, entry: str | None = None) -> DataFrame:
    x = comparable_pairs(rows, group=group, entry=entry)
    return x.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("ties") / 2.0, F.col("n_pairs")))


def calibration(rows: DataFrame, n: int = 3) -> DataFrame:
    """Observed and expected rate by n classes of score of about equal size; equal scores stay together."""
    from .joins import average_rank

    x = average_rank(rows, "score", "_r", share=True)
    return x.groupBy(F.least(F.lit(n - 1), F.floor(F.col("_r") * n)).cast("int").alias("class")).agg(F.count("*").alias("n"), F.avg("score").alias("expected"), F.avg("label").alias("observed"))


def out_of_fold_rate(rows: DataFrame, cells: list[str], fold: str, label: str = "label") -> DataFrame:
    """Rows with the label rate of their cell in the other folds; the rate of all other folds where the cell has none."""
    c = rows.groupBy(*cells, fold).agg(F.sum(label).alias("_y"), F.count("*").alias("_n"))
    t = rows.groupBy(fold).agg(F.sum(label).alias("_ty"), F.count("*").alias("_tn"))
    every = Window.partitionBy(*cells)
    c = c.withColumns({"_oy": F.sum("_y").over(every) - F.col("_y"), "_on": F.sum("_n").over(every) - F.col("_n")}).select(*cells, fold, "_oy", "_on")
    t = t.withColumns({"_ay": F.sum("_ty").over(Window.partitionBy()) - F.col("_ty"), "_an": F.sum("_tn").over(Window.partitionBy()) - F.col("_tn")}).select(fold, "_ay", "_an")  # a row a fold
    x = rows.join(c, [*cells, fold], "left").join(F.broadcast(t), fold)
    return x.withColumn("rate", F.coalesce(F.try_divide("_oy", "_on"), F.try_divide("_ay", "_an"))).drop("_oy", "_on", "_ay", "_an")


def verdicts(by_repeat: DataFrame, run: str, metric: str, reference: str) -> DataFrame:
    """Per run: mean difference to the reference and win, lose or tie against the pooled sd over repeats."""
    g = by_repeat.groupBy(run).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_pop(metric), F.lit(0.0)).alias("sd"))
    ref = g.filter(F.col(run) == reference).select(F.col("mean").alias("_m"), F.col("sd").alias("_s"))
    x = g.crossJoin(F.broadcast(ref)).withColumn("diff", F.col("mean") - F.col("_m"))  # one row
    pooled_sd = F.sqrt((F.pow("sd", 2) + F.pow("_s", 2)) / 2)
    return x.withColumn("verdict", F.when(F.col("diff") > pooled_sd, "win").when(F.col("diff") < -pooled_sd, "lose").otherwise("tie")).drop("_m", "_s")
