"""Profiles: quality, quantiles, histograms, rates, trends, exposure and person-time tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def unpivot(rows: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form of metric columns, as doubles."""
    return rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, name, value)


def quality(rows: DataFrame) -> DataFrame:
    """column, dtype, n_null, null_share: one pass."""
    one = rows.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("n_null"), (F.col(c) / F.col("_n")).alias("null_share")) for c, t in rows.dtypes))
    return one.select(F.explode(each).alias("r")).select("r.*")


def trip_aggregates(rows: DataFrame) -> DataFrame:
    """Aggregates per vehicle of derived trips, with rates per day and per 1,000 km; partial aggregation is Spark's own."""
    km, days = F.sum("trip_km"), F.greatest((F.max(F.unix_micros("t_end")) - F.min(F.unix_micros("t_start"))) / 86_400e6, F.lit(1.0))
    rate = lambda x: F.try_divide(x * 1000.0, F.nullif(km, F.lit(0.0)))
    p = lambda c, q: F.percentile(c, F.lit(q))
    return rows.groupBy("vehicle_id").agg(
        F.count("*").alias("n_trips"), km.alias("km"), days.alias("days"), (F.count("*") / days).alias("trips_per_day"), (km / days).alias("km_per_day"), F.count_if("idle").alias("n_idle"), F.count_if("moving").alias("n_moving"), F.count_if("short").alias("n_short"), F.count_if("urban").alias("n_urban"),
        F.avg("minutes").alias("minutes_mean"), p("minutes", 0.5).alias("minutes_p50"), p("minutes", 0.9).alias("minutes_p90"), F.avg("kmh").alias("kmh_mean"), F.max("kmh").alias("kmh_max"),
        F.avg("level_end").alias("level_mean"), p("level_end", 0.1).alias("level_p10"), p("level_end", 0.5).alias("level_p50"), p("level_end", 0.9).alias("level_p90"), F.stddev_samp("level_end").alias("level_sd"), F.min("level_end").alias("level_min"), F.max("level_end").alias("level_max"),
        F.count_if("saturated").alias("n_saturated"), rate(F.count_if("saturated")).alias("saturated_per_1000km"), F.count_if("abnormal").alias("n_abnormal"), rate(F.count_if("abnormal")).alias("abnormal_per_1000km"), F.count_if("cleaning").alias("n_cleaning"), rate(F.count_if("cleaning")).alias("cleaning_per_1000km"),
        F.count("regen_drop").alias("n_drops"), F.avg("regen_drop").alias("drop_mean"), rate(F.count("regen_drop")).alias("drops_per_1000km"), F.avg("fuel_100km").alias("fuel_mean"), p("fuel_100km", 0.5).alias("fuel_p50"), F.avg("amplitude").alias("amplitude_mean"),
        F.min("odo_end").alias("odo_first"), F.max("odo_end").alias("odo_last"), F.count_if("cold_start").alias("n_cold"))


def slope_per_1000km(y: str, x: str = "odo_end") -> Column:
    return F.regr_slope(F.col(y), F.col(x)) * 1000


def scoped_rates(rows: DataFrame, flag: Column, scopes: tuple[float, ...] = (1.0, 0.8, 0.7)) -> DataFrame:
    """Per vehicle and scope (share of its odometer range): rows, flagged rows, and rate per 1,000 km."""
    ends = rows.groupBy("vehicle_id").agg(F.max("odo_end").alias("_top"))
    x = rows.withColumn("_f", flag).join(ends, "vehicle_id").withColumn("scope", F.explode(F.array(*(F.lit(s) for s in scopes)))).filter(F.col("odo_end") <= F.col("scope") * F.col("_top"))
    return x.groupBy("vehicle_id", "scope").agg(F.count("*").alias("n"), F.count_if("_f").alias("n_flag"), F.try_divide(F.count_if("_f") * 1000.0, F.nullif(F.sum("trip_km"), F.lit(0.0))).alias("per_1000km"))


def exact_quantiles(rows: DataFrame, keys: list[str], metrics: list[str], probs: tuple[float, ...]) -> DataFrame:
    """n and the exact quantiles of each metric by keys, whatever the groups' sizes. Groups are few."""
    x = unpivot(rows, keys, metrics)
    return quantiles(x, [*keys, "metric"], [(f"p{int(p * 100):02d}", "value", p) for p in probs], [F.count("value").alias("n")])


def histogram(rows: DataFrame, keys: list[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts in n equal bins of [lo, hi]; what lies outside falls into the end bins; share within the group."""
    b = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(value) - lo) / ((hi - lo) / n)))).cast("int")
    x = rows.filter(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def daily_activity(rows: DataFrame) -> DataFrame:
    d = F.to_date("t_start")
    return rows.groupBy(d.alias("d")).agg(F.count("*").alias("n_trips"), F.countDistinct("vehicle_id").alias("n_vehicles"), F.sum("trip_km").alias("km")).withColumns({"weekday": F.dayofweek("d"), "month": F.date_format("d", "yyyy-MM")})


def origin_estimate(rows: DataFrame, vehicles: DataFrame, by: list[str] = ()) -> DataFrame:
    """Calendar origin: median, spread and range over vehicles of first trip day less production day."""
    first = rows.groupBy("vehicle_id").agg(F.min(F.unix_micros("t_start")).alias("us")).join(vehicles, "vehicle_id")
    x = first.withColumn("o", F.floor(F.col("us") / 86_400e6) - F.col("production_day"))
    facts = [F.count("*").alias("n"), F.stddev_samp("o").alias("sd"), F.min("o").alias("lo"), F.max("o").alias("hi")]
    q = quantiles(x, list(by), [("median", "o", 0.5), ("_q1", "o", 0.25), ("_q3", "o", 0.75)], facts)
    return q.select(*by, "n", "median", "sd", (F.col("_q3") - F.col("_q1")).alias("iqr"), "lo", "hi")


def weighted_cells(rows: DataFrame, keys: list[str], value: str, weight: str, least: float) -> DataFrame:
    """value per weight by cell, null under the least weight; the weight is kept."""
    w = F.sum(weight)
    return rows.groupBy(*keys).agg(F.when(w >= least, F.sum(value) / w).alias("value"), w.alias("weight"))


def person_days(vehicles: DataFrame, start: str, end: str, event: str) -> DataFrame:
    """One row per vehicle and day from start to end (dates, both included): dss, month, and whether the event is on that day."""
    x = vehicles.filter(F.col(start) <= F.col(end)).withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))
    return x.withColumns({"dss": F.datediff("day", start), "month": F.date_format("day", "yyyy-MM"), "is_event": F.coalesce(F.col("day") == F.col(event), F.lit(False)).cast("int")})


def expected_events(reference: DataFrame, other: DataFrame, bin_days: int) -> DataFrame:
    """Expected and observed events of other's person days under the hazard by dss bin of the reference."""
    b = F.floor(F.col("dss") / bin_days).alias("bin")
    haz = reference.groupBy(b).agg((F.sum("is_event") / F.count("*")).alias("h"))
    x = other.groupBy("window", b).agg(F.count("*").alias("exposure"), F.sum("is_event").alias("e")).join(haz, "bin", "left")
    return x.groupBy("window").agg(F.sum(F.col("exposure") * F.coalesce("h", F.lit(0.0))).alias("expected"), F.sum("e").alias("observed"))


def binned(rows: DataFrame, value: Column, bin_km: float, least: int, keys=("vehicle_id",)) -> DataFrame:
    """mean of value and flagged rate per vehicle and odometer bin with at least so many rows."""
    x = rows.groupBy(*keys, (F.floor(F.col("odo_end") / bin_km) * bin_km).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("value"), F.sum("trip_km").alias("km"))
    return x.filter(F.col("n") >= least)


def aligned_profile(rows: DataFrame, bin_km: float, value: str, least: int) -> DataFrame:
    """Median over vehicles of their mean value by bin of km to the event; bins with fewer vehicles drop out."""
    x = rows.filter("km_to_event is not null").groupBy("vehicle_id", (F.floor(F.col("km_to_event") / bin_km) * bin_km).alias("bin")).agg(F.avg(value).alias("v"))
    return quantiles(x, ["bin"], [("median", "v", 0.5)], [F.count("*").alias("n_vehicles")]).filter(F.col("n_vehicles") >= least)


def paired_change(rows: DataFrame, phase: Column, metrics: list[str]) -> DataFrame:
    """Per metric: vehicles with both phases, median of after - before, and the share that decreases."""
    x = unpivot(rows.withColumn("_after", phase), ["vehicle_id", "_after"], metrics).groupBy("vehicle_id", "metric")
    x = x.agg(F.avg(F.when(~F.col("_after"), F.col("value"))).alias("b"), F.avg(F.when(F.col("_after"), F.col("value"))).alias("a"))
    x = x.filter("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    falling = F.avg((F.col("d") < 0).cast("double")).alias("share_decreasing")
    return quantiles(x, ["metric"], [("median_delta", "d", 0.5)], [F.count("*").alias("n_vehicles"), falling])


def stability(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One-way ICC over vehicles and the median coefficient of variation within them, per metric."""
    x = unpivot(rows, ["vehicle_id"], metrics).filter("value is not null").groupBy("metric", "vehicle_id")
    x = x.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v")).filter("n >= 2")
    n, m = F.col("n"), F.col("m")
    sums = [
        F.count("*").alias("k"), F.sum(n).alias("N"), F.sum(n * n).alias("n2"), F.sum(n * m).alias("t"),
        F.sum(n * m * m).alias("t2"), F.sum((n - 1) * F.col("v")).alias("ssw"),
    ]
    g = quantiles(x, ["metric"], [("median_cv", F.sqrt("v") / F.nullif(F.abs("m"), F.lit(0.0)), 0.5)], sums)
    k, n = F.col("k"), F.col("N")
    msb, msw = (F.col("t2") - F.col("t") * F.col("t") / n) / (k - 1), F.col("ssw") / (n - k)
    n0 = (n - F.col("n2") / n) / (k - 1)
    return g.select("metric", k.alias("n_vehicles"), ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), "median_cv")


def around_day(rows: DataFrame, ref: DataFrame, days: int, value: str) -> DataFrame:
    """Mean of value by relative day to each vehicle's reference time, over a full spine of days."""
    x = rows.join(ref, "vehicle_id").withColumn("rel", F.floor((F.unix_micros("t_start") - F.unix_micros("at")) / 86_400e6)).filter(F.abs("rel") <= days)
    spine = rows.sparkSession.range(-days, days + 1).select(F.col("id").alias("rel"))
    return spine.join(x.groupBy("rel").agg(F.count("*").alias("n"), F.avg(value).alias("mean")), "rel", "left").select("rel", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def dispersion(rows: DataFrame, scales: list[str]) -> DataFrame:
    """Per scale: n, sd of logs, coefficient of variation, quartile coefficient of dispersion. Values must be above 0."""
    x = unpivot(rows, [], scales, "scale").filter("value > 0")
    facts = [F.count("*").alias("n"), F.stddev_samp(F.log("value")).alias("sd_log"), (F.stddev_samp("value") / F.avg("value")).alias("cv")]
    x = quantiles(x, ["scale"], [("_q1", "value", 0.25), ("_q3", "value", 0.75)], facts)
    return x.select("scale", "n", "sd_log", "cv", ((F.col("_q3") - F.col("_q1")) / (F.col("_q3") + F.col("_q1"))).alias("qcd"))


def ranked_corr(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and Spearman's rho (average ranks)."""
    from .joins import average_rank

    z = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    z = average_rank(average_rank(z, x, "_rx"), y, "_ry")
    return z.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def shape(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: skewness, p99 / p50, share of zeros, skewness after log1p, and the transform it suggests."""
    x = unpivot(rows, [], metrics).filter("value is not null")
    facts = [
        F.count("*").alias("n"), F.skewness("value").alias("skew"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"),
        F.skewness(F.log1p(F.greatest("value", F.lit(0.0)))).alias("skew_log"),
    ]
    x = quantiles(x, ["metric"], [("_p50", "value", 0.5), ("_p99", "value", 0.99)], facts)
    kind = F.when(F.col("zero_share") > 0.5, "indicator").when((F.col("skew") > 1) & (F.abs("skew_log") < F.abs("skew")), "log1p").otherwise("none")
    return x.select("metric", "n", "skew", F.try_divide("_p99", F.nullif(F.col("_p50"), F.lit(0.0))).alias("tail"), "zero_share", "skew_log", kind.alias("suggest"))


def edges(rows: DataFrame, value: str, probs: tuple[float, ...]) -> DataFrame:
    """One row: cut points of the reference set."""
    q = quantiles(rows, [], [(f"_e{i}", value, p) for i, p in enumerate(probs)])
    return q.select(F.array(*(f"_e{i}" for i in range(len(probs)))).alias("edges"))


def assign(rows: DataFrame, cut: DataFrame, value: str, name: str) -> DataFrame:
    """Class of value among (-inf, e1], (e1, e2], ...; cut has one row."""
    return rows.crossJoin(cut).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("edges", lambda e: F.col(value) > e)))).drop("edges")


def monotone_summary(trends: DataFrame, rho: str, cohort: str) -> DataFrame:
    """Per cohort: vehicles, median rho, share with rho > 0, signed-rank sum of rho, and a verdict."""
    from .joins import average_rank

    x = average_rank(trends.filter(F.col(rho).isNotNull() & (F.col(rho) != 0)).withColumn("_a", F.abs(rho)), "_a", "_r", [cohort])
    rising = F.col(rho) > 0
    facts = [F.count("*").alias("n"), F.avg(rising.cast("double")).alias("share_up"), F.sum(F.when(rising, F.col("_r")).otherwise(0.0)).alias("w_plus")]
    g = quantiles(x, [cohort], [("median_rho", rho, 0.5)], facts)
    return g.withColumn("verdict", F.when(F.col("share_up") >= 0.75, "rising").when(F.col("share_up") <= 0.25, "falling").otherwise("none"))


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).fillna(0, [str(v) for v in values])


def grid(spark, **axes) -> DataFrame:
    """All combinations of a few parameter values: a table of fixed size, in one partition, that joins broadcast."""
    rows = spark.range(0, 1, 1, 1).select(*(F.array(*(F.lit(float(v)) for v in vs)).alias(k) for k, vs in axes.items()))
    for k in axes:
        rows = rows.withColumn(k, F.explode(k))
    return F.broadcast(rows)
