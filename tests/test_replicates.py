"""Bootstrap replicates as vectors against replicate-by-replicate sums."""

import random

import numpy as np
import pytest

from fleetspan.operators import metrics as M
from fleetspan.operators import resample

ROW = "vehicle_id long, score double, label int"


def brute(rows, n, seed):
    vehicles = sorted({r[0] for r in rows})
    w = dict(zip(vehicles, resample.poisson_weights(vehicles, n, seed)))
    out = []
    for k in range(n):
        u = p = q = 0.0
        pos, neg = ([(s, w[v][k]) for v, s, y in rows if y == label and s is not None] for label in (1, 0))
        p, q = sum(x for _, x in pos), sum(x for _, x in neg)
        for s, x in pos:
            u += sum(x * y * ((t < s) + (t == s) / 2) for t, y in neg)
        out.append(u / (p * q) if p * q else None)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_poisson_auc_matches_sums_of_each_replicate(spark, ranges, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 7)
    rng = random.Random(ranges)
    rows = [(v, rng.choice([rng.random(), 0.5, 0.5, 0.25]), rng.randrange(2)) for v in range(40) for _ in range(rng.randrange(1, 5))] + [(3, None, 1)]  # half have one score
    got = {r["replicate"]: r["auc"] for r in resample.poisson_auc(spark.createDataFrame(rows, ROW).repartition(3), 12, 5, ranges).collect()}
    want = brute(rows, 12, 5)
    assert len(got) == 12 and all(got[k] == pytest.approx(x, abs=1e-12) for k, x in enumerate(want))


def test_one_shuffle_of_rows_whatever_the_replicates(spark):
    df = spark.createDataFrame([(v, v / 7, v % 2) for v in range(50)], ROW)
    plans = [resample.poisson_auc(df, n, 1, 4)._jdf.queryExecution().executedPlan().toString().count("Exchange") for n in (2, 1000)]
    assert plans[0] == plans[1]


def test_poisson_weights_have_mean_and_variance_one():
    w = resample.poisson_weights(list(range(400)), 100, 2)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and (resample.poisson_weights([7], 3, 2) == w[7, :3]).all()
    assert resample.poisson_weights([], 4, 1).shape == (0, 4) and np.all(np.diff(resample.POISSON) >= 0)


def test_levels_and_importance_read_their_rows_once(spark):
    rows = spark.createDataFrame([(1, 100.0, 0, 0.5), (1, 200.0, 0, 0.7), (1, 300.0, 0, 0.6), (2, 100.0, 1, 0.9)], "vehicle_id long, cut_odo double, event_observed int, score double")
    lv = M.vehicle_levels(rows, 2)
    assert sorted(map(tuple, lv.collect())) == [(1, 0, 0.6), (2, 1, None)]
    assert "Join" not in lv._jdf.queryExecution().executedPlan().toString()
    from fleetspan.queries import load

    plan = load()[0]["e10_permutation_importance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["n05_detection_null", "n06_bag_size_null"])
def test_permuted_levels_are_made_once(spark, name):
    from fleetspan.queries import load

    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    outside = "\n".join(line for line in plan.splitlines() if "InMemoryRelation" in line)
    assert "replicate" in outside and "level" in outside
    spark.catalog.clearCache()
