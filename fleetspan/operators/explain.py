"""Explanation and decision tables over alerts and feature contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import AT, KEY, first_alerts, sustained


def vehicle_alerts(rows: DataFrame, tau: float, k: int) -> DataFrame:
    """Per vehicle: alert_odo, lead and outcome (detected, missed, false_alarm, quiet)."""
    v = rows.groupBy(KEY).agg(F.max("event_observed").alias("event_observed"), F.max("score").alias("top_score"))
    x = v.join(first_alerts(rows, tau, k), KEY, "left")
    ev, hit = F.col("event_observed") == 1, F.col("alert_odo").isNotNull()
    return x.withColumn("outcome", F.when(ev & hit, "detected").when(ev, "missed").when(hit, "false_alarm").otherwise("quiet"))


def explained_cuts(rows: DataFrame, tau: float, k: int, levels: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """The k cuts of a vehicle's first alert, or the cut of its greatest score, with a risk level."""
    a = first_alerts(rows, tau, k).select(KEY, "alert_odo")
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), AT)
    x = rows.join(a, KEY, "left").withColumn("_top", F.row_number().over(w)).withColumn("_k", F.sum((F.col(AT) >= F.col("alert_odo")).cast("int")).over(Window.partitionBy(KEY).orderBy(AT)))
    x = x.filter((F.col("alert_odo").isNotNull() & (F.col(AT) >= F.col("alert_odo")) & (F.col("_k") <= k)) | (F.col("alert_odo").isNull() & (F.col("_top") == 1)))
    return x.select(KEY, AT, "score", F.col("alert_odo").isNotNull().alias("alerted"), F.when(F.col("score") >= levels[1], "high").when(F.col("score") >= levels[0], "medium").otherwise("low").alias("risk"))


def vehicle_means(cuts: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    return cuts.select(KEY, AT).join(values, [KEY, AT]).groupBy(KEY).agg(*(F.avg(c).alias(c) for c in columns))


def long_contributions(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.select(KEY, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([KEY], features, "feature", "phi")


def family_sums(contrib: DataFrame, families: dict[str, str]) -> DataFrame:
    m = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    return contrib.groupBy(KEY, F.coalesce(m[F.col("feature")], F.lit("other")).alias("family")).agg(F.sum("phi").alias("phi"))


def top_contributors(contrib: DataFrame, k: int) -> DataFrame:
    """Per vehicle: its k greatest positive contributors."""
    w = Window.partitionBy(KEY).orderBy(F.desc("phi"), "feature")
    return contrib.filter("phi > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stability(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per vehicle: Jaccard of the top-k sets of two replicates, and the share of features whose signs agree."""
    s = lambda x, n: top_contributors(x, k).groupBy(KEY).agg(F.collect_set("feature").alias(n))
    signs = a.join(b.select(KEY, "feature", F.col("phi").alias("phi_b")), [KEY, "feature"]).groupBy(KEY).agg(F.avg((F.signum("phi") == F.signum("phi_b")).cast("double")).alias("sign_agreement"))
    x = signs.join(s(a, "sa"), KEY, "left").join(s(b, "sb"), KEY, "left")
    none = F.array().cast("array<string>")
    u, i = F.size(F.array_union(F.coalesce("sa", none), F.coalesce("sb", none))), F.size(F.array_intersect(F.coalesce("sa", none), F.coalesce("sb", none)))
    return x.select(KEY, F.when(u > 0, i / u).otherwise(1.0).alias("jaccard"), "sign_agreement")


def plausibility(assoc: DataFrame, expected: dict[str, int]) -> DataFrame:
    """assoc: (feature, rho). Verdict against the expected sign."""
    m = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    e = m[F.col("feature")]
    return assoc.withColumn("verdict", F.when(e.isNull() | (e == 0), "free").when(F.abs("rho") < 0.05, "flat").when(F.signum("rho") == e, "plausible").otherwise("against"))


def message_factors(contrib: DataFrame, least: float, allowed: list[str], n: int = 3) -> DataFrame:
    return top_contributors(contrib.filter((F.col("phi") >= least) & F.col("feature").isin(*allowed)), n)


def waterfall(contrib: DataFrame, k: int, context: list[str]) -> DataFrame:
    """Steps per vehicle: its k greatest contributors by size, the rest, and context features."""
    w = Window.partitionBy(KEY, F.col("feature").isin(*context)).orderBy(F.desc(F.abs("phi")), "feature")
    x = contrib.withColumn("r", F.row_number().over(w))
    step = F.when(F.col("feature").isin(*context), "context").when(F.col("r") <= k, F.col("feature")).otherwise("rest")
    return x.groupBy(KEY, step.alias("step")).agg(F.sum("phi").alias("phi"))


def horizon_weeks(horizon_km: Column, km_per_day: Column) -> Column:
    return F.greatest(F.lit(1.0), F.bround(F.try_divide(horizon_km, km_per_day) / 7, 0))


def with_runs(rows: DataFrame, k: int) -> DataFrame:
    return sustained(rows, k)
