"""Fits of all folds at once: optimality by hand, no leaks, and as many jobs for many folds as for few."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.plans import fits, models

ROW = "vehicle_id long, cut_odo double, label int, a double, b double, m string"


def panel(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, rng.gauss(2, 3)]), rng.gauss(-1, 0.5)
        m = rng.choice(["x", "x", "y", "z", None]) if i != 7 else "rare"
        z = 0.6 * (a or 0) + b + (1.0 if m == "y" else 0) - 0.5
        rows.append((i // 4, 100.0 * (i % 4), int(rng.random() < 1 / (1 + np.exp(-z))), a, b, m))
    return rows


def design(rows, train, least=5):
    """Prepared columns by the training rows, written out by hand."""
    t = [rows[i] for i in train]
    cols = []
    for j in (3, 4):
        med = float(np.median([r[j] for r in t if r[j] is not None]))
        v = np.array([med if r[j] is None else r[j] for r in t])
        cols.append([((med if r[j] is None else r[j]) - v.mean()) / v.std() for r in rows])
    counts = {v: sum(r[5] == v for r in t) for v in {r[5] for r in t if r[5] is not None}}
    kept = {v for v, n in counts.items() if n >= least}
    mode = sorted(kept, key=lambda v: (-counts[v], v))[0]
    value = [mode if r[5] is None else r[5] if r[5] in kept else "other" for r in rows]
    return cols, value


def conditions(rows, train, coef, names, intercept, l2, l1, balance):
    """Greatest miss of the conditions of the optimum, from scratch."""
    cols, value = design(rows, train)
    x = np.array([[c[i] for c in cols] + [float(n.split("=")[1] == value[i]) for n in names[2:]] for i in train])
    y = np.array([rows[i][2] for i in train])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) / len(y) if balance else np.full(len(y), 1 / len(y))
    p = 1 / (1 + np.exp(-(x @ coef + intercept)))
    g = x.T @ (w * (p - y)) + l2 * coef
    miss = np.where(coef != 0, np.abs(g + l1 * np.sign(coef)), np.maximum(np.abs(g) - l1, 0))
    return max(miss.max(), abs((w * (p - y)).sum())), p


@pytest.mark.parametrize("kind", [fits.Logistic(l2=0.1, balance=True), fits.Logistic(l1=0.02, balance=True), fits.Logistic(l2=0.01, l1=0.01)])
def test_every_fold_is_at_its_optimum(spark, kind):
    rows = panel(1)
    folds = [(r, (v * 7 + r * 3) % (3 + r), v) for r in range(2) for v in range(60)]  # three folds, then four
    df, fd = spark.createDataFrame(rows, ROW).repartition(3), spark.createDataFrame(folds, "repeat int, fold int, vehicle_id long")
    pairs = models.fold_numbers(fd)
    assert len(pairs) == 7
    x = models.with_training(df, fd, pairs)
    found = fits.fit(x, ["a", "b"], ["m"], models.training_weights(len(pairs)), len(pairs), kind)
    assert found.violation.max() <= 1e-8 and found.steps < 40
    names, by = found.preparation.names(), {(r, v): k for r, k, v in folds}
    scores = {(r["vehicle_id"], r["cut_odo"]): dict(zip(r["which"], r["scores"])) for r in found.apply(x, ["vehicle_id", "cut_odo"], F.col("held")).collect()}
    for i, (r, k) in enumerate(pairs):
        train = [j for j, row in enumerate(rows) if by[r, row[0]] != k]
        miss, _ = conditions(rows, train, found.coefficients[i], names, found.intercepts[i], kind.l2, kind.l1, kind.balance)
        assert miss <= 1e-6
        cols, value = design(rows, train)
        for j, row in enumerate(rows):
            assert (i in scores[row[0], row[1]]) == (by[r, row[0]] == k)
            if by[r, row[0]] == k:
                z = found.coefficients[i] @ np.array([c[j] for c in cols] + [float(n.split("=")[1] == value[j]) for n in names[2:]]) + found.intercepts[i]
                assert scores[row[0], row[1]][i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
    if kind.l1:
        assert (found.coefficients == 0).any()


def test_jobs_do_not_depend_on_the_number_of_folds(spark):
    df = spark.createDataFrame(panel(2), ROW)
    jobs = []
    for k in (2, 12):
        fd = spark.createDataFrame([(0, v % k, v) for v in range(60)], "repeat int, fold int, vehicle_id long")
        spark.sparkContext.setJobGroup(f"folds{k}", "")
        pairs = models.fold_numbers(fd)
        found = fits.fit(models.with_training(df, fd, pairs), ["a", "b"], ["m"], models.training_weights(k), k, fits.Logistic(l2=0.1))
        jobs.append((len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{k}")), found.steps))
    spark.sparkContext.setJobGroup("", "")
    per_step = (jobs[1][0] - jobs[0][0]) / max(1, jobs[1][1] - jobs[0][1]) if jobs[1][1] != jobs[0][1] else 0
    assert abs(jobs[1][1] - jobs[0][1]) <= 3 and per_step <= 4 and jobs[1][0] < 1.6 * jobs[0][0]


def test_what_a_fold_holds_out_does_not_move_its_scores(spark):
    rows = panel(3)
    fd = spark.createDataFrame([(0, v % 3, v) for v in range(60)], "repeat int, fold int, vehicle_id long")
    other = [(*r[:2], 1 - r[2], 50.0, -9.0, "strange") if r[0] % 3 == 1 else r for r in rows]
    run = lambda rs: {(r["vehicle_id"], r["cut_odo"]): r["score"] for r in models.run_cv(spark.createDataFrame(rs, ROW), fd, "logistic", ["a", "b"], ["m"]).collect()}
    b = fits.fit(models.with_training(spark.createDataFrame(rows, ROW), fd, [(0, 0), (0, 1), (0, 2)]), ["a", "b"], ["m"], models.training_weights(3), 3, models.MODELS["logistic"])
    c = fits.fit(models.with_training(spark.createDataFrame(other, ROW), fd, [(0, 0), (0, 1), (0, 2)]), ["a", "b"], ["m"], models.training_weights(3), 3, models.MODELS["logistic"])
    assert np.allclose(b.coefficients[1], c.coefficients[1][[c.preparation.names().index(n) for n in b.preparation.names()]], atol=1e-7)
    assert len(run(rows)) == len(rows)


def test_weights_count_as_repeats_and_separated_classes_warn(spark):
    rows = panel(4, 80)
    df = spark.createDataFrame(rows, ROW)
    w = F.array((F.col("vehicle_id") % 3).cast("double"))
    one = fits.fit(df, ["b"], [], w, 1, fits.Logistic(l2=0.05))
    two = fits.fit(spark.createDataFrame([r for r in rows for _ in range(r[0] % 3)], ROW), ["b"], [], F.array(F.lit(1.0)), 1, fits.Logistic(l2=0.05))
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-7) and np.allclose(one.intercepts, two.intercepts, atol=1e-7)
    apart = spark.createDataFrame([(i, 0.0, int(i > 9), float(i), 0.0, "x") for i in range(20)], ROW)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        fits.fit(apart, ["a"], [], F.array(F.lit(1.0)), 1, fits.Logistic(), rounds=8)
    assert any("no finite optimum" in str(t.message) for t in told)
    none = fits.fit(df.limit(0), ["b"], ["m"], F.array(F.lit(1.0)), 1, fits.Logistic(l2=0.05))
    assert none.steps == 0 and not none.coefficients.any()


def test_hazard_model_with_spline_and_late_entry(spark):
    """Likelihood against a fit by hand on the same person-period rows."""
    from fleetspan.plans.panel import stack_periods

    rng = random.Random(5)
    rows = [(i, 0.0, rng.uniform(50, 1200), rng.randrange(2), rng.choice([0.0, 100.0, 250.0]), rng.gauss(0, 1)) for i in range(400)]
    rows = [r for r in rows if r[2] > r[4]]
    df = spark.createDataFrame(rows, "vehicle_id long, cut_odo double, duration double, event int, entry double, x double")
    stacked = stack_periods(df, "entry", "duration", "event", 100, 1000)
    found, names, design = models.hazard_fit(stacked, ["x"], fits.Logistic(l2=0.01))
    data = design(stacked).select("x", *names, "hazard", "bin", "entry").toPandas()
    assert (data["bin"] >= data["entry"] // 100).all()  # nothing before the entry
    z = data[["x", *names]].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    y = data["hazard"].to_numpy()
    b, c = np.zeros(z.shape[1]), 0.0
    for _ in range(60):  # Newton's method by hand
        p = 1 / (1 + np.exp(-(z @ b + c)))
        one = np.hstack([z, np.ones((len(z), 1))])
        ridge = np.append(np.full(len(b), 0.01), 0.0)
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one / len(y) + np.diag(ridge), one.T @ (p - y) / len(y) + ridge * np.append(b, c))
        b, c = b - step[:-1], c - step[-1]
    assert np.allclose(found.coefficients[0], b, atol=1e-6) and abs(found.intercepts[0] - c) < 1e-6
    knots = models.baseline_knots(stacked, 5)
    assert knots == sorted(set(np.quantile(data["bin"], np.linspace(0.05, 0.95, 5))))
    out = models.hazard_scores(stacked, df, ["x"], 8, fits.Logistic(l2=0.01)).collect()
    assert len(out) == len(rows) and all(0 < r["score"] < 1 for r in out)
    with pytest.raises(ValueError, match="three knots"):
        models.baseline_knots(stacked.filter("bin < 2"), 5)


def test_classes_against_the_rest(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    x = np.eye(3)[y] * 4 + rng.standard_normal((300, 3))
    df = spark.createDataFrame([(i, 0.0, float(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x))], "vehicle_id long, cut_odo double, class double, a double, b double, c double")
    out = models.one_vs_rest(df, ["a", "b", "c"], "class").collect()
    assert sum(r["hat"] == r["class"] for r in out) > 280
