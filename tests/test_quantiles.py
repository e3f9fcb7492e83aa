"""Exact quantiles by selection against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.operators import quantiles as Q

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0)


def check(df, rows, by, columns, probs=PROBS, **how):
    wanted = [(f"{c}_{i}", c, p) for c in columns for i, p in enumerate(probs)]
    out = Q.quantiles(df, by, wanted, [F.count("*").alias("n")], **how).collect()
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in by), []).append(r)
    assert {tuple(r[k] for k in by) for r in out} == set(groups) and len(out) == len(groups)
    for r in out:
        own = groups[tuple(r[k] for k in by)]
        assert r["n"] == len(own)
        for name, c, p in wanted:
            x = [o[c] for o in own if o[c] is not None]
            assert (r[name] is None) if not x else r[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12), (name, r)


@pytest.mark.parametrize("plain", [0, 1 << 16])
def test_groups_of_all_sizes_null_keys_and_null_values(spark, plain, monkeypatch):
    monkeypatch.setattr(Q, "PLAIN", plain)
    rng = random.Random(1)
    rows = [{"g": rng.choice(["a", "b", None]), "h": rng.choice([1.5, None]), "x": rng.choice([None, rng.gauss(0, 1), 2.0]), "y": rng.randrange(5)} for _ in range(300)]
    rows += [{"g": "one", "h": 1.5, "x": 7.0, "y": 1}, {"g": "none", "h": 1.5, "x": None, "y": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "g string, h double, x double, y long")
    check(df, rows, ["g", "h"], ["x", "y"])
    check(df, rows, ["g"], ["x"], few_groups=False)
    assert Q.quantiles(df.limit(0), ["g"], [("q", "x", 0.5)]).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "two values", "huge range"])
def test_one_group_holds_all_rows(spark, kind, monkeypatch):
    """With brackets much smaller than the group."""
    monkeypatch.setattr(Q, "PLAIN", 0)
    monkeypatch.setattr(Q, "ACCURACY", 500)
    monkeypatch.setattr(Q, "MARGIN", 0.008)
    monkeypatch.setattr(Q, "SMALL", 1000)
    rng = random.Random(2)
    draw = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([1.0, rng.random() * 3]), "two values": lambda: float(rng.random() < 0.25), "huge range": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)}[kind]
    rows = [{"g": 1, "x": draw()} for _ in range(20_000)] + [{"g": 2, "x": draw()} for _ in range(1500)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "g int, x double").repartition(5)
    check(df, rows, ["g"], ["x"], probs=(0.0, 0.1, 0.25, 0.5, 0.9, 1.0))
    check(df, rows, [], ["x"], probs=(0.5,))


def test_a_bracket_that_misses_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(Q, "PLAIN", 0)
    monkeypatch.setattr(Q, "SMALL", 0)
    monkeypatch.setattr(Q, "MARGIN", -0.2)
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("x"))
    with pytest.raises(Exception, match="missed its rank"):
        Q.quantiles(df, ["g"], [("q", "x", 0.5)]).collect()
