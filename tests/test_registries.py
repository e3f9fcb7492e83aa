"""Channels, targets, decoders and reporters declared by name; a user's own entry of each kind."""

import math

import pytest
from pyspark.sql import functions as F

from fleetspan.plans import panel, panes, targets


def cells(spark, channels):
    rows = spark.createDataFrame([(1, 10.0, 4.0), (1, 30.0, 6.0), (1, 35.0, 8.0), (1, 90.0, 1.0)], "vehicle_id long, odo_end double, x double")
    cuts = spark.createDataFrame([(1, 100.0)], "vehicle_id long, cut_odo double")
    out = panel.declared_sequences(rows, cuts, channels, 100.0, 25.0).orderBy("t").collect()
    return {c.name: [r[c.name] for r in out] for c in channels}


def test_channels_fills_and_transforms(spark):
    got = cells(spark, [panel.Channel(f"f_{k}", "x", "mean", k) for k in ("none", "zero", "carry", "carry_zero")] + [panel.Channel("n", "*", "count", "zero"), panel.Channel("l", "x", "sum", "zero", "log1p")])
    assert got == {"f_none": [4.0, 7.0, None, 1.0], "f_zero": [4.0, 7.0, 0.0, 1.0], "f_carry": [4.0, 7.0, 7.0, 1.0], "f_carry_zero": [4.0, 7.0, 7.0, 1.0],
                   "n": [1.0, 2.0, 0.0, 1.0], "l": [pytest.approx(math.log1p(x)) for x in (4, 14, 0, 1)]}
    for bad in ({"agg": "mode"}, {"fill": "guess"}, {"transform": "cube"}):
        with pytest.raises(ValueError, match="not known"):
            panel.Channel("a", "x", **({"agg": "mean"} | bad))


def test_a_user_adds_an_entry_of_each_kind(spark, monkeypatch):
    monkeypatch.setitem(panes.CHANNELS, "spread", lambda x: F.max(x) - F.min(x))
    monkeypatch.setitem(panel.FILLS, "minus", lambda x, past, rest: F.coalesce(x, F.lit(-1.0)))
    monkeypatch.setitem(panel.TRANSFORMS, "double", lambda x: x * 2)
    assert cells(spark, [panel.Channel("s", "x", "spread", "minus", "double")]) == {"s": [0.0, 4.0, -2.0, 0.0]}
    monkeypatch.setitem(targets.TARGETS, "near", lambda km: {"near": F.coalesce(F.col("time_to_event_km") <= km, F.lit(False))})
    monkeypatch.setitem(targets.DECODERS, "first", lambda p: {"score": p[0], "other": p[1]})
    monkeypatch.setitem(targets.REPORTERS, "greatest", lambda rows: rows.agg(F.max("score").alias("top")))
    rows = spark.createDataFrame([(100.0, [0.2, 0.8]), (None, [0.7, 0.3])], "time_to_event_km double, p array<double>")
    x = targets.decode(targets.with_targets(rows, [targets.Target("near", {"km": 200})]), "first", "p")
    assert [(r["near"], r["score"], r["other"]) for r in x.collect()] == [(True, 0.2, 0.8), (False, 0.7, 0.3)]
    assert targets.report(x, "greatest").first()["top"] == 0.7


def test_targets_decoders_and_reporters_by_name(spark):
    rows = spark.createDataFrame([(1, 250.0, 900.0, 1), (0, None, 500.0, 0)], "event_observed int, time_to_event_km double, km_after double, label int")
    x = targets.with_targets(rows, [targets.Target("survival", {"gap_km": 100}), targets.Target("ordinal", {"edges": (600, 300)}, {"class": "y"}), targets.Target("cure", {"window_km": 400}, {"event": "cured"})])
    assert [(r["duration"], r["event"], r["at_risk"], r["y"], r["cured"]) for r in x.collect()] == [(150.0, 1, True, 3, 1), (400.0, 0, True, 0, 0)]
    p = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], 1, 1, 2)], "p array<double>, label int, event_observed int, class int")
    d = targets.decode(p, "ordinal", "p", classes=4, at_least=2).first()
    assert d["score"] == pytest.approx(0.7) and d["p_at_least_1"] == pytest.approx(0.9) and d["p_at_least_3"] == pytest.approx(0.4)
    assert targets.decode(p, "hazards", "p").first()["score"] == pytest.approx(1 - 0.9 * 0.8 * 0.7 * 0.6)
    b = targets.report(targets.decode(p, "binary", "p"), "binary").first()
    assert (b["n"], b["base_rate"]) == (1, 1.0) and b["brier"] == pytest.approx(0.64)
    assert targets.report(targets.decode(p, "binary", "p"), "ordinal").first()["share"] == 1.0
    for call in (lambda: targets.Target("none").parts(), lambda: targets.decode(p, "none", "p"), lambda: targets.report(p, "none"), lambda: targets.Target("cure", {"window_km": 4}, {"x": "y"}).parts()):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError, match="two targets"):
        targets.with_targets(rows, [targets.Target("survival", {"gap_km": 1})] * 2)
