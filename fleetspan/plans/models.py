"""Models with grouped folds, hazard models, reference normalisers, ensembles and survival curves.

Logistic models of all folds, replicates and classes are fitted together (plans.fits); other estimators are pipelines of pyspark.ml, one a fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import natural_spline, uniform  # noqa: F401
from ..operators.joins import average_rank, fallback_lookup
from ..operators.quantiles import quantiles
from . import fits, targets
from .fits import Logistic

KEYS = ["vehicle_id", "cut_odo"]


def preprocessor(numeric: list[str], categorical: list[str] = (), least: int = 5) -> list:
    """Stages: median impute and scale; categories seen less than `least` times in training share one level."""
    imputed = [f"{c}__i" for c in numeric]
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    parts = ["_scaled"]
    if categorical:
        stages += [RareLevels(list(categorical), least), StringIndexer(inputCols=[f"{c}__r" for c in categorical], outputCols=[f"{c}__x" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__x" for c in categorical], outputCols=[f"{c}__o" for c in categorical])]
        parts += [f"{c}__o" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


#: Levels that a category may have.
LEVELS = 10_000


class RareLevels(Estimator):
    """Learns which levels are frequent, and the most frequent; rare ones become 'other', missing ones the most frequent."""

    def __init__(self, columns: list[str], least: int):
        super().__init__()
        self.columns, self.least = columns, least

    def _fit(self, dataset):
        kept, mode = {}, {}
        for c in self.columns:  # a dimension's levels: few by nature, LEVELS at most
            found = dataset.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().filter(F.col("count") >= self.least)
            rows = found.orderBy(F.desc("count"), "v").limit(LEVELS + 1).collect()
            if len(rows) > LEVELS:
                raise ValueError(f"{c} has more than {LEVELS} levels; it is no category")
            kept[c] = [r["v"] for r in rows]
            mode[c] = kept[c][0] if rows else "other"
        return RareLevelsModel(kept, mode)


class RareLevelsModel(Transformer):
    def __init__(self, kept, mode):
        super().__init__()
        self.kept, self.mode = kept, mode

    def _transform(self, dataset):
        v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(self.mode[c]))
        return dataset.withColumns({f"{c}__r": F.when(v(c).isin(kept), v(c)).otherwise("other") for c, kept in self.kept.items()})


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight, so that both classes weigh the same."""
    w = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumn("weight", F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).drop("_n")  # a row a class
    return rows.join(F.broadcast(w), label)


#: Registry of classifiers: a Logistic, whose fits run together, or a function that makes an Estimator over features, label, weight.
MODELS = {
    "logistic": Logistic(l2=0.1, balance=True),
    "logistic_l1": Logistic(l1=0.01, balance=True),
    "gbt": lambda: GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=5, maxDepth=3, seed=3),
}


def probability(df: DataFrame) -> Column:
    return vector_to_array("probability")[1]


def fold_numbers(folds: DataFrame) -> list[tuple[int, int]]:
    """(repeat, fold) of each fit, in order."""
    return sorted((r["repeat"], r["fold"]) for r in folds.select("repeat", "fold").distinct().collect())  # a row a fold


def with_training(rows: DataFrame, folds: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """rows with held: numbers of the fits (in pairs) that leave the row's vehicle out. Vehicles without fold are trained on by all."""
    number = F.create_map(*(F.lit(x) for i, (r, k) in enumerate(pairs) for x in (f"{r}|{k}", i)))
    own = folds.groupBy("vehicle_id").agg(F.collect_set(number[F.concat_ws("|", "repeat", "fold")]).alias("held"))  # a fold a repeat
    return rows.join(own, "vehicle_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))


def training_weights(n_fits: int, weight: Column | float = 1.0) -> Column:
    """weight where a fit trains on the row, 0 where it holds it out."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.transform(F.sequence(F.lit(0), F.lit(n_fits - 1)), lambda i: F.when(F.array_contains("held", i), 0.0).otherwise(w))


def run_cv(rows: DataFrame, folds: DataFrame, model: str, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """Out-of-fold scores in long form: vehicle_id, cut_odo, label, repeat, fold, score. All is fitted on the other folds only."""
    pairs, kind = fold_numbers(folds), MODELS[model]
    if isinstance(kind, Logistic):
        x = with_training(rows, folds, pairs)
        found = fits.fit(x, numeric, list(categorical), training_weights(len(pairs)), len(pairs), kind)
        out = found.apply(x, [*KEYS, "label"], F.col("held")).select(*KEYS, "label", F.explode(F.arrays_zip("which", "scores")).alias("x"))
        repeat, fold = (F.array(*(F.lit(p[i]) for p in pairs)) for i in (0, 1))
        return out.select(*KEYS, "label", F.get(repeat, F.col("x.which")).alias("repeat"), F.get(fold, F.col("x.which")).alias("fold"), F.col("x.scores").alias("score"))
    out = []
    rows = rows.persist()
    for repeat, fold in pairs:
        held = folds.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).select("vehicle_id")
        train, test = class_weights(rows.join(held, "vehicle_id", "left_anti")), rows.join(held, "vehicle_id", "left_semi")
        fitted = Pipeline(stages=[*preprocessor(numeric, categorical), kind()]).fit(train)
        scored = fitted.transform(test.withColumn("weight", F.lit(1.0)))
        out.append(scored.select(*KEYS, "label", F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), probability(scored).alias("score")))
    return reduce(DataFrame.unionByName, out)


def mean_scores(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEYS).agg(F.first("label").alias("label"), F.avg("score").alias("score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("score_std"))


def final_fit(train: DataFrame, test: DataFrame, model: str, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    kind = MODELS[model]
    if isinstance(kind, Logistic):
        found = fits.fit(train, numeric, list(categorical), F.array(F.lit(1.0)), 1, kind)
        return found.apply(test, [*KEYS, "label"]).select(*KEYS, "label", F.col("scores")[0].alias("score"))
    fitted: PipelineModel = Pipeline(stages=[*preprocessor(numeric, categorical), kind()]).fit(class_weights(train))
    scored = fitted.transform(test.withColumn("weight", F.lit(1.0)))
    return scored.select(*KEYS, "label", probability(scored).alias("score"))


def base_rate_scores(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Score of a row: the label rate of the other folds."""
    t = rows.groupBy(fold).agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    every = Window.partitionBy()  # a row a fold
    t = t.select(fold, ((F.sum("y").over(every) - F.col("y")) / (F.sum("n").over(every) - F.col("n"))).alias("score"))
    return rows.join(F.broadcast(t), fold)


def random_scores(rows: DataFrame, seed: int) -> DataFrame:
    """Score of a row: a number in [0, 1) that seed, vehicle and cut determine."""
    return rows.withColumn("score", uniform(seed, F.col("vehicle_id"), F.col("cut_odo").cast("bigint")))


def fold_average(train: DataFrame, folds: DataFrame, test: DataFrame, model: str, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """Mean and spread over the fold models (each fitted without one fold of each repeat) of the test rows' scores."""
    pairs, kind = fold_numbers(folds), MODELS[model]
    if isinstance(kind, Logistic):
        found = fits.fit(with_training(train, folds, pairs), numeric, list(categorical), training_weights(len(pairs)), len(pairs), kind)
        return mean_scores(found.apply(test, [*KEYS, "label"]).select(*KEYS, "label", F.explode("scores").alias("score")))
    out = []
    for repeat, fold in pairs:
        held = folds.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).select("vehicle_id")
        out.append(final_fit(train.join(held, "vehicle_id", "left_anti"), test, model, numeric, categorical))
    return mean_scores(reduce(DataFrame.unionByName, out))


#: Ends of the range of quantiles at which the knots of a baseline hazard stand.
KNOTS = (0.05, 0.95)


def baseline_knots(stacked: DataFrame, n: int) -> list[float]:
    """Knots of the baseline hazard: n equally spaced quantiles of the bins at risk; equal ones count once."""
    shares = [KNOTS[0] + (KNOTS[1] - KNOTS[0]) * i / (n - 1) for i in range(n)]
    found = quantiles(stacked, [], [(f"_k{i}", "bin", p) for i, p in enumerate(shares)]).first()
    knots = sorted({x for x in found if x is not None})
    if len(knots) < 3:
        raise ValueError(f"a spline needs three knots; the bins at risk give {knots}")
    return knots


def hazard_fit(stacked: DataFrame, features: list[str], kind: Logistic = Logistic(l2=0.01), n_knots: int = 5) -> tuple[fits.Fits, list[str], Callable]:
    """(fit, its columns, function that adds them) of a discrete-time hazard model on person-period rows (bin, hazard).

    The baseline hazard is a natural cubic spline of the bin, linear beyond the end knots, so bins with few rows don't run away. Late entry is in
    the rows: a row gives only the bins from its entry on.
    """
    knots = baseline_knots(stacked, n_knots)
    basis = natural_spline(F.col("bin").cast("double"), tuple(knots))
    names = [f"_s{i}" for i in range(len(basis))]
    design = lambda x: x.withColumns(dict(zip(names, basis)))
    found = fits.fit(design(stacked), [*features, *names], [], F.array(F.lit(1.0)), 1, kind, target="hazard")
    return found, names, design


def hazard_scores(stacked: DataFrame, rows: DataFrame, features: list[str], bins: int, kind: Logistic = Logistic(l2=0.01), n_knots: int = 5) -> DataFrame:
    """Score of a row: 1 - prod(1 - h_b) over the horizon's bins, by hazard_fit."""
    found, _, design = hazard_fit(stacked, features, kind, n_knots)
    grid = rows.select(*KEYS, *features).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    scored = found.apply(design(grid), KEYS).select(*KEYS, F.col("scores")[0].alias("h"))
    return scored.groupBy(*KEYS).agg((1 - F.exp(F.sum(F.log1p(-F.least("h", F.lit(1 - 1e-12)))))).alias("score"))


def exposure_scores(stacked: DataFrame, rows: DataFrame, features: list[str], bins: int, width: float) -> DataFrame:
    """Piecewise-exponential model: Poisson with log exposure as offset; score is 1 - exp(-cumulative hazard)."""
    names = [*features, "bin_d"]
    prep = lambda x: x.withColumns({"bin_d": F.col("bin").cast("double"), "log_exposure": F.log(F.col("exposure"))})
    stages = [Imputer(strategy="median", inputCols=names, outputCols=[f"{c}__i" for c in names]), VectorAssembler(inputCols=[f"{c}__i" for c in names], outputCol="features"), GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="hazard", offsetCol="log_exposure", regParam=0.01, maxIter=25)]
    fitted = Pipeline(stages=stages).fit(prep(stacked.filter("exposure > 1e-9").withColumn("hazard", F.col("hazard").cast("double"))))
    grid = rows.select(*KEYS, *features).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("exposure", F.lit(width))
    return fitted.transform(prep(grid)).groupBy(*KEYS).agg((1 - F.exp(-F.sum("prediction"))).alias("score"))


def poisson_table(cells: DataFrame, factors: list[str], events: str = "events", exposure: str = "days") -> DataFrame:
    """Rate ratios by category against the first level, with 95 % intervals, deviance and AIC. cells is an aggregated table."""
    x = cells.withColumns({c: F.col(c).cast("string") for c in factors}).withColumns({"y": F.col(events).cast("double"), "off": F.log(F.col(exposure).cast("double"))})
    indexer = StringIndexer(inputCols=factors, outputCols=[f"{c}__x" for c in factors], stringOrderType="alphabetDesc").fit(x)
    stages = [indexer, OneHotEncoder(inputCols=[f"{c}__x" for c in factors], outputCols=[f"{c}__o" for c in factors]), VectorAssembler(inputCols=[f"{c}__o" for c in factors], outputCol="features"), GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol="y", offsetCol="off", maxIter=30)]
    m = Pipeline(stages=stages).fit(x).stages[-1]
    names = [f"{c}={v}" for c, labels in zip(factors, indexer.labelsArray) for v in labels[:-1]]  # the last, first in order, is the reference
    b, se = list(m.coefficients) + [m.intercept], m.summary.coefficientStandardErrors
    import math

    e = lambda x: math.exp(min(700.0, x))  # noqa: E731 - a level without events has no finite ratio
    rows = [(n, e(c), e(c - 1.959964 * s), e(c + 1.959964 * s), float(m.summary.deviance), float(m.summary.aic)) for n, c, s in zip([*names, "intercept"], b, se)]
    return cells.sparkSession.createDataFrame(rows, "term string, rate_ratio double, lo double, hi double, deviance double, aic double")


def chi2_sf(x: float, df: int) -> float:
    """Probability of a chi-square variable with df degrees of freedom above x."""
    import math

    if x <= 0:
        return 1.0
    half = x / 2
    term, total = (math.exp(-half), math.exp(-half)) if df % 2 == 0 else (0.0, math.erfc(math.sqrt(half)))
    for k in range(1, (df + 1) // 2 if df % 2 else df // 2):
        term = term * half / k if df % 2 == 0 else math.exp((k - 0.5) * math.log(half) - half - math.lgamma(k + 0.5))
        total += term
    return total


def likelihood_ratio(cells: DataFrame, nested: list[list[str]], events: str = "events", exposure: str = "days") -> DataFrame:
    """A row per step of a chain of nested factor sets: deviance and AIC of both models, the statistic, its degrees of freedom and p."""
    fits = []
    for factors in nested:
        rows = poisson_table(cells, factors, events, exposure).collect() if factors else None  # a row a term
        if rows is None:
            one = cells.agg(F.sum(events).alias("_y"), F.sum(exposure).alias("_e"))
            k, mu = F.col(events).cast("double"), F.col(exposure) * F.col("_y") / F.col("_e")
            part = F.when(k > 0, k * F.log(k / mu)).otherwise(0.0) - (k - mu)
            fits.append((1, cells.crossJoin(F.broadcast(one)).agg(2 * F.sum(part)).first()[0], None))  # one row
        else:
            fits.append((len(rows), rows[0]["deviance"], rows[0]["aic"]))
    out = []
    for (a, b), small, large in zip(zip(fits, fits[1:]), nested, nested[1:]):
        stat, df = a[1] - b[1], b[0] - a[0]
        out.append(("+".join(small) or "1", "+".join(large), float(a[1]), float(b[1]), a[2], b[2], float(stat), df, chi2_sf(stat, df)))
    return cells.sparkSession.createDataFrame(out, "small string, large string, deviance_small double, deviance_large double, aic_small double, aic_large double, statistic double, df int, p double")


def ordinal_scores(rows: DataFrame, features: list[str], label: str, classes: int, at_least: int) -> DataFrame:
    """P(class >= at_least) of a multinomial logistic model."""
    stages = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__i" for c in features]), VectorAssembler(inputCols=[f"{c}__i" for c in features], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", regParam=0.05, maxIter=20)]
    scored = Pipeline(stages=stages).fit(rows).transform(rows)
    scored = scored.select(*KEYS, label, vector_to_array("probability").alias("_p"))
    return targets.decode(scored, "ordinal", "_p", classes=classes, at_least=at_least).select(*KEYS, label, "score")


def one_vs_rest(rows: DataFrame, features: list[str], label: str, kind: Logistic = Logistic(l2=0.05)) -> DataFrame:
    """hat: the class with the highest score of the models of one class against the others, which are fitted together."""
    classes = sorted(int(r[0]) for r in rows.select(label).distinct().collect() if r[0] is not None)  # a row a class
    known = F.array(*(F.lit(c) for c in classes))
    target = F.transform(known, lambda c: (F.col(label) == c).cast("double"))
    found = fits.fit(rows.filter(F.col(label).isNotNull()), features, [], F.array_repeat(F.lit(1.0), len(classes)), len(classes), kind, target=target)
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    return found.apply(rows, [*KEYS, label]).select(*KEYS, label, F.get(known, best).cast("int").alias("hat"))


def bagged(rows: DataFrame, weights: DataFrame, model: str, numeric: list[str]) -> DataFrame:
    """Mean score of one model per replicate, each fitted on vehicles by their multiplicities."""
    kind, replicates = MODELS[model], sorted(r[0] for r in weights.select("replicate").distinct().collect())  # a row a replicate
    if isinstance(kind, Logistic):
        drawn = weights.groupBy("vehicle_id").agg(F.map_from_entries(F.collect_list(F.struct("replicate", F.col("weight").cast("double")))).alias("drawn"))  # an entry a replicate
        x = rows.join(drawn, "vehicle_id", "left")
        w = F.transform(F.array(*(F.lit(b) for b in replicates)), lambda b: F.coalesce(F.try_element_at("drawn", b), F.lit(0.0)))
        found = fits.fit(x, numeric, [], w, len(replicates), Logistic(kind.l2, kind.l1))
        return found.apply(rows, [*KEYS, "label"]).select(*KEYS, "label", (F.aggregate("scores", F.lit(0.0), lambda a, b: a + b) / len(replicates)).alias("score"))
    out = []
    for b in replicates:
        train = rows.join(weights.filter(F.col("replicate") == b).select("vehicle_id", F.col("weight").cast("double").alias("weight")), "vehicle_id")
        s = Pipeline(stages=[*preprocessor(numeric), kind()]).fit(train).transform(rows.withColumn("weight", F.lit(1.0)))
        out.append(s.select(*KEYS, "label", probability(s).alias("score")))
    return reduce(DataFrame.unionByName, out).groupBy(*KEYS).agg(F.first("label").alias("label"), F.avg("score").alias("score"))


class FleetReference:
    """Reference of healthy training vehicles: median per cell of one value per vehicle and month; cells with few vehicles fall back."""

    def __init__(self, least: int = 5):
        self.least, self.tables = least, []

    def fit(self, cells: DataFrame, levels: list[tuple[str, list[str]]]) -> "FleetReference":
        """cells: long rows with vehicle_id, the levels' keys and value, of healthy training vehicles."""
        self.tables = []
        for name, keys in levels:
            one = cells.groupBy("vehicle_id", *keys).agg(F.avg("value").alias("value"))  # a vehicle has one vote in a cell
            ref = quantiles(one, keys, [("ref", "value", 0.5)], [F.count("*").alias("n")])  # cells are few
            self.tables.append((name, keys, ref.filter(F.col("n") >= (self.least if keys else 1)).drop("n")))
        return self

    def transform(self, cells: DataFrame, weight: str = "weight") -> DataFrame:
        """Weighted mean deviation from the reference per vehicle."""
        x = fallback_lookup(cells, self.tables, "ref")
        ok = F.col("ref").isNotNull() & F.col("value").isNotNull()
        return x.groupBy("vehicle_id").agg((F.sum(F.when(ok, (F.col("value") - F.col("ref")) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))).alias("deviation"))


def unit_index(rows: DataFrame, train: Column, signs: dict[str, int]) -> DataFrame:
    """Sum of signed standardised columns; mean and sd of the training rows. Missing values count as the mean."""
    s = rows.filter(train).agg(*(f(c).alias(f"_{n}_{c}") for c in signs for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    x = rows.crossJoin(F.broadcast(s))  # one row
    total = reduce(lambda a, b: a + b, (F.lit(float(g)) * F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c, g in signs.items()))
    return x.withColumn("index", total).drop(*s.columns)


def rank_ensemble(runs: list[tuple[DataFrame, float]], by: list[str] = ()) -> DataFrame:
    """Weighted mean of the runs' percentile ranks."""
    out = []
    for r, w in runs:
        out.append(average_rank(r, "score", "pr", list(by), share=True).select(*by, *KEYS, "label", (F.col("pr") * w).alias("v"), F.lit(float(w)).alias("w")))
    return reduce(DataFrame.unionByName, out).groupBy(*by, *KEYS).agg(F.first("label").alias("label"), (F.sum("v") / F.sum("w")).alias("score"))


def platt(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Out-of-fold probabilities of a logistic model on the score."""
    values = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a row a fold
    known = F.array(*(F.lit(v) for v in values))
    own = (F.array_position(known, F.col(fold)) - 1).cast("int")
    x = rows.withColumn("held", F.array(own))
    found = fits.fit(x, ["score"], [], training_weights(len(values)), len(values), Logistic())
    return found.apply(x, [*KEYS, "label", fold], F.col("held")).select(*KEYS, "label", fold, F.col("scores")[0].alias("p"))


def calibration_slope(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: slope and intercept of a logistic model on logit(score)."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    found = fits.fit(rows.select("label", F.log(p / (1 - p)).alias("z")), ["z"], [], F.array(F.lit(1.0)), 1, Logistic())
    slope = found.coefficients[0, 0] * found.preparation.scale[0, 0]
    return rows.sparkSession.createDataFrame([(float(slope), float(found.intercepts[0] - slope * found.preparation.mean[0, 0]))], "slope double, intercept double")


def kaplan_meier(rows: DataFrame, by: list[str], duration: str, event: str) -> DataFrame:
    """(by, t, at_risk, events, survival) at event times; at-risk counts come from running counts over distinct durations."""
    from ..operators.joins import running_counts

    h = rows.groupBy(*by, F.col(duration).cast("double").alias("t")).agg(F.count("*").alias("c"), F.sum(event).alias("d"))
    x = running_counts(h, by, "t", ["c"]).withColumn("at_risk", F.col("c_all") - F.col("c_below")).filter("d > 0")
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(float("-inf"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(*by, "t", "at_risk", F.col("d").alias("events"), F.exp(F.sum(step).over(w)).alias("survival"))


def median_survival(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, median): the first time at which survival is a half or less; null where it never is."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("t"))).alias("median"))


def log_rank(rows: DataFrame, group: str, duration: str, event: str) -> DataFrame:
    """Observed and expected events per group over all event times."""
    times = rows.filter(F.col(event) == 1).groupBy(F.col(duration).cast("double").alias("t")).agg(F.count("*").alias("d"))
    counts = rows.groupBy(group, F.col(duration).cast("double").alias("u")).agg(F.count("*").alias("c"))
    g = times.crossJoin(rows.select(group).distinct())  # event times by groups
    from ..operators.joins import running_counts

    spine = g.select(group, F.col("t").alias("u"), F.lit(0).cast("bigint").alias("c")).unionByName(counts.select(group, "u", "c")).groupBy(group, "u").agg(F.sum("c").alias("c"))
    r = running_counts(spine, [group], "u", ["c"]).select(group, F.col("u").alias("t"), (F.col("c_all") - F.col("c_below")).alias("r"))
    x = g.join(r, [group, "t"]).withColumn("n", F.sum("r").over(Window.partitionBy("t")))
    e = x.groupBy(group).agg(F.sum(F.try_divide(F.col("d") * F.col("r"), F.col("n"))).alias("expected"))
    return e.join(rows.groupBy(group).agg(F.sum(event).cast("bigint").alias("observed")), group)
