"""Hand-made cases with known answers, invariants and metamorphic checks."""

import math

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import asof, dedupe, derive, explain, joins, metrics, resample, splits
from fleetspan.operators import profile as P
from fleetspan.plans import models, panel, risk
from fleetspan.sources import tables

TRIP = "vehicle_id string, event_id long, t_start timestamp, t_end timestamp, odo_end double"


def daily(spark, spec):
    """Vehicles that drive km a day from a date on: (id, first day, days, km)."""
    x = spark.createDataFrame(spec, "vehicle_id string, d string, n int, km double")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.timestamp_micros(F.unix_micros(F.col("d").cast("timestamp")) + F.col("i") * 86_400_000_000)
    return x.select("vehicle_id", F.col("i").cast("long").alias("event_id"), t.alias("t_start"), t.alias("t_end"), (F.col("i") * F.col("km")).alias("odo_end"))


def test_loader_renames_offsets_and_cuts(spark):
    failed = spark.createDataFrame([("A", "600", "1"), ("B", "540", "x")], "VehicleCode string, day string, EventDay string")
    healthy = spark.createDataFrame([("C", "10")], "vehicle_id string, production_day string")
    parts = [tables.Part(failed, "failed", {"VehicleCode": "vehicle_id", "day": "production_day", "EventDay": "event_day"}, {"production_day": -538}), tables.Part(healthy, "healthy")]
    got = {r["vehicle_id"]: (r["production_day"], r["event_day"], r["cohort"]) for r in tables.load_table(parts, {"production_day": "double", "event_day": "double"}).collect()}
    assert got == {"A": (62.0, 1.0, "failed"), "B": (2.0, None, "failed"), "C": (10.0, None, "healthy")}
    trips = spark.createDataFrame([("A", "2025-09-10"), ("A", "2025-09-20T00:00:00.000Z"), ("B", "2025-09-11T10:00:00Z"), ("C", "2025-09-12 01:02:03"), ("D", "no date")], "vehicle_id string, t string")
    for cols in (None, ["vehicle_id"]):
        out = tables.load_table([tables.Part(trips, "a")], dates=["t"], columns=cols, cut=("t", "2025-09-14"))
        assert sorted(r["vehicle_id"] for r in out.collect()) == ["A", "B", "C", "D"]


def test_dedupe_of_repeated_events(spark):
    x = spark.createDataFrame([("A", 400.0), ("A", 250.0), ("B", None), ("C", 90.0)], "vehicle_id string, event_day double")
    got = {r["vehicle_id"]: (r["event_day"], r["n_events_recorded"]) for r in dedupe.one_row_per_vehicle(x).collect()}
    assert got == {"A": (250.0, 2), "B": (None, 0), "C": (90.0, 1)}


def test_canonical_ids_collapse_clones(spark):
    x = spark.createDataFrame([("a", 1, "healthy"), ("a2", 1, "failed"), ("b", 1, "healthy")], "vehicle_id string, k int, cohort string")
    al = spark.createDataFrame([("a2", "a")], "alias string, vehicle_id string")
    assert sorted(map(tuple, dedupe.collapse_clones(x, al).collect())) == [("a", 1, "failed"), ("b", 1, "healthy")]


def test_asof_interpolates_and_marks_its_source(spark):
    t = daily(spark, [("A", "2024-01-01", 10, 10.0)])
    d = spark.createDataFrame([("A", "2024-01-03 12:00:00"), ("A", "2024-01-05"), ("A", "2023-12-01"), ("A", "2024-03-01"), ("Z", "2024-01-01")], "vehicle_id string, s string").select("vehicle_id", F.col("s").cast("timestamp").alias("d"))
    got = {(r["source"], r["event_odo"]) for r in asof.project_dates_to_odometer(d, t, "d").collect()}
    assert got == {("interpolated", 25.0), ("exact", 40.0), ("before_history", 0.0), ("after_history", 100.0)}
    pts = spark.createDataFrame([("A", 25.0), ("A", 40.0), ("A", -1.0), ("A", 101.0)], "vehicle_id string, x double")
    back = {r["x"]: str(r["date"]) for r in asof.project_odometer_to_dates(pts, t, "x").collect()}
    assert back == {25.0: "2024-01-03 12:00:00", 40.0: "2024-01-05 00:00:00", -1.0: "None", 101.0: "None"}


def test_inverse_asof_takes_the_first_time_on_a_plateau(spark):
    rows = [("A", 0, 0.0), ("A", 1, 10.0), ("A", 2, 10.0), ("A", 3, 20.0)]
    t = spark.createDataFrame(rows, "vehicle_id string, h int, odo_end double").withColumn("t_start", F.timestamp_micros(F.col("h") * 3_600_000_000))
    pts = spark.createDataFrame([("A", 10.0), ("A", 15.0)], "vehicle_id string, x double")
    got = {r["x"]: r["us"] / 3.6e9 for r in asof.project_odometer_to_dates(pts, t, "x").select("x", F.unix_micros("date").alias("us")).collect()}
    assert got == {10.0: 1.0, 15.0: 2.5}


def test_registry_window_in_km(spark):
    t = daily(spark, [("F", "2025-07-01", 400, 50.0), ("S", "2025-08-01", 120, 50.0), ("T", "2026-02-01", 200, 50.0)])
    cuts = spark.createDataFrame([("F", 1000.0, 6000.0), ("F", 6000.0, None)], "vehicle_id string, cut_odo double, event_odo double")
    out = {r["cut_odo"]: (r["entry_km"], r["exit_km"], r["risk_event"]) for r in risk.km_risk(cuts, t, "2025-09-01", "2026-03-11", 500.0).collect()}
    # the window runs from 3,100 to 12,650 km
    assert out == {1000.0: (1600.0, 4500.0, 1), 6000.0: (0.0, 6150.0, 0)}


def test_late_entry_stacking(spark):
    rows = [(0, 0.0, 1200.0, 1), (1, 1100.0, 2600.0, 0), (2, 700.0, 700.0, 1), (3, 3200.0, 4000.0, 1), (4, 0.0, 5000.0, 1)]
    x = panel.stack_periods(spark.createDataFrame(rows, "cut int, entry double, duration double, event int"), "entry", "duration", "event", 500, 3000).collect()
    n = {}
    for r in x:
        n[r["cut"]] = n.get(r["cut"], 0) + 1
    assert n == {0: 3, 1: 4, 2: 1, 4: 6}
    assert {(r["cut"], r["bin"]) for r in x if r["hazard"]} == {(0, 2), (2, 1)}


def test_exposure_adds_up(spark):
    rows = [(0, 0.0, 120.0, 1), (1, 30.0, 250.0, 0), (2, 90.0, 80.0, 1)]
    x = panel.stack_exposure(spark.createDataFrame(rows, "k int, entry double, exit double, event int"), "entry", "exit", "event", 50.0, 200.0)
    assert {r["k"]: (r["e"], r["h"]) for r in x.groupBy("k").agg(F.sum("exposure").alias("e"), F.sum("hazard").alias("h")).collect()} == {0: (120.0, 1), 1: (170.0, 0)}


def test_windows_see_nothing_after_the_cut(spark):
    cuts = spark.createDataFrame([("A", 300.0), ("A", 400.0)], "vehicle_id string, cut_odo double")
    t = spark.createDataFrame([("A", i, float(i * 7)) for i in range(100)], "vehicle_id string, event_id long, odo_end double").withColumn("v", F.col("odo_end") % 13)
    agg = lambda x: sorted(map(tuple, panel.window_rows(x, cuts, 200, 100).groupBy("vehicle_id", "cut_odo").agg(F.sum("v"), F.count("*")).collect()))
    a = agg(t)
    assert a[0] == agg(t.withColumn("v", F.when(F.col("odo_end") > 300, 999.0).otherwise(F.col("v"))))[0] != agg(t.withColumn("v", F.when(F.col("odo_end") > 400, 1.0).otherwise(0.0)))[0]
    want = [sum((7 * i) % 13 for i in range(100) if c - 200 < 7 * i <= c) for c in (300, 400)]
    assert [r[2] for r in a] == want


def scores(spark, n=80):
    """Vehicles with 1 to 11 cuts."""
    rows = []
    for v in range(n):
        for c in range(1 + v % 11):
            s = ((v * 7919 + c * 104729) % 1000) / 1000
            rows.append((v, float(c), int(v % 4 == 0 and c > 3), int(v % 4 == 0), 100.0 * (11 - c) if v % 4 == 0 else None, 50.0 * c, s))
    return spark.createDataFrame(rows, "vehicle_id long, cut_odo double, label int, event_observed int, time_to_event_km double, km_after double, score double")


def test_levels_detect_as_sustained_alerts_do(spark):
    s = scores(spark)
    lv = metrics.vehicle_levels(s, 2).persist()
    for tau in (0.2, 0.5, 0.8):
        by_level = {r[0] for r in lv.filter(F.col("level") >= tau).select("vehicle_id").collect()}
        assert by_level == {r["vehicle_id"] for r in metrics.first_alerts(s, tau, 2).collect()}
    t = metrics.exact_tau(lv, [0.1])
    r = t.first()
    healthy = sorted((x["level"] for x in lv.filter("event_observed = 0 and level is not null").collect()), reverse=True)
    assert r["tau"] == healthy[r["m"]] and r["m"] == math.floor(0.1 * 60 + 1e-9)
    assert metrics.detection(lv, t).first()["false_alarms"] <= 0.1


def test_rank_metrics_against_definitions(spark):
    s = scores(spark).withColumn("score", F.round("score", 1))
    rows = [(r["score"], r["label"]) for r in s.collect()]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(s).first()["auc"] == pytest.approx(auc, abs=1e-12)
    ap, seen = 0.0, 0.0
    for t in sorted({x for x, _ in rows}, reverse=True):
        hit = [y for x, y in rows if x >= t]
        recall = sum(hit) / len(pos)
        ap += (recall - seen) * sum(hit) / len(hit)
        seen = recall
    assert metrics.average_precision(s).first()["ap"] == pytest.approx(ap, abs=1e-12)
    ranks = {r["score"]: r["r"] for r in joins.average_rank(s, "score", "r").collect()}
    for x in ranks:
        assert ranks[x] == sum(y < x for y, _ in rows) + (sum(y == x for y, _ in rows) + 1) / 2


def test_base_rate_score_has_the_base_rate(spark):
    s = scores(spark).withColumn("score", F.lit(0.5))
    r = metrics.average_precision(s).first()
    assert r["ap"] == pytest.approx(r["base_rate"]) and metrics.roc_auc(s).first()["auc"] == 0.5


def test_concordance_against_pairs(spark):
    rows = [(float(d), e, s / 7, float(a)) for d, e, s, a in ((5, 1, 3, 0), (5, 0, 2, 0), (8, 1, 3, 6), (9, 0, 1, 4), (2, 1, 6, 0), (8, 1, 1, 0))]
    c = metrics.concordance(spark.createDataFrame(rows, "duration double, event int, score double, entry double"), entry="entry").first()
    pairs = [(x, y) for x in rows for y in rows if x[1] == 1 and y[3] < x[0] and (y[0] > x[0] or y[0] == x[0] and y[1] == 0)]
    assert c["n_pairs"] == len(pairs)
    assert c["c_index"] == pytest.approx(sum((x[2] > y[2]) + (x[2] == y[2]) / 2 for x, y in pairs) / len(pairs))


def test_folds_are_grouped_stratified_and_extend(spark):
    v = spark.createDataFrame([(i, i % 5, i % 3) for i in range(600)], "vehicle_id long, market int, engine int")
    s = splits.composite_strata(v, ["market", "engine"], 5).persist()
    assert s.groupBy("stratum").count().agg(F.min("count")).first()[0] >= 5
    side = splits.holdout(s, 5, 1).join(s, "vehicle_id")
    for r in side.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "test").alias("t")).collect():
        assert abs(r["t"] - r["n"] / 5) <= 1
    old = splits.folds(s.filter("vehicle_id < 400"), 5, 2, 1).persist()
    new = splits.extend_folds(old, s, 5, 2).persist()
    assert new.join(old, ["repeat", "vehicle_id", "fold"]).count() == old.count() and new.count() == 1200
    for r in new.join(s, "vehicle_id").groupBy("repeat", "stratum").pivot("fold", list(range(5))).agg(F.count(F.lit(1))).collect():
        n = [r[str(i)] or 0 for i in range(5)]
        assert max(n) - min(n) <= 1
    joins.assert_disjoint(side.filter("side = 'test'"), side.filter("side = 'dev'"))
    with pytest.raises(joins.LeakError):
        joins.assert_disjoint(s, s)


def test_permutations_keep_the_multiset(spark):
    s = scores(spark).withColumn("cut", F.col("cut_odo").cast("bigint"))
    for within in ([], ["vehicle_id"]):
        p = resample.permute(s, ["score"], 3, ["vehicle_id", "cut"], within).persist()
        by = [*within, "score"]
        assert p.count() == s.count() and p.groupBy(*by).count().exceptAll(s.groupBy(*by).count()).count() == 0
        assert p.select("vehicle_id", "cut", "score").exceptAll(s.select("vehicle_id", "cut", "score")).count() > 0
        assert p.exceptAll(resample.permute(s, ["score"], 3, ["vehicle_id", "cut"], within)).count() == 0


def test_bootstrap_weights_sum_to_the_vehicles(spark):
    w = resample.bootstrap_weights(scores(spark), 10, 4)
    assert {r[0] for r in w.groupBy("replicate").agg(F.sum("weight").alias("w")).select("w").collect()} == {80}
    x = resample.bootstrap_weights(scores(spark), 10, 4, "event_observed").join(scores(spark).select("vehicle_id", "event_observed").distinct(), "vehicle_id")
    assert {(r[1], r[2]) for r in x.groupBy("replicate", "event_observed").agg(F.sum("weight")).collect()} == {(0, 60), (1, 20)}


def test_weights_of_one_give_the_plain_metrics(spark):
    s = scores(spark).withColumn("weight", F.lit(1))
    assert metrics.roc_auc(s, weight="weight").first()["auc"] == pytest.approx(metrics.roc_auc(s).first()["auc"])
    lv = metrics.vehicle_levels(s, 2)
    one = lv.select("vehicle_id", F.lit(0).alias("replicate"), F.lit(1).alias("weight"))
    d = metrics.detection(lv, metrics.exact_tau(lv, [0.2])).first()["detection"]
    assert resample.weighted_detection(lv, one, 0.2).first()["detection"] == pytest.approx(d)


def test_causal_mean(spark):
    rows = [("A", 1.0, 0.3), ("A", 2.0, 0.6), ("A", 3.0, 0.9), ("B", 1.0, 0.5), ("B", 2.0, 0.1)]
    from pyspark.sql import Window

    w = Window.partitionBy("v").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    got = [round(r["m"], 9) for r in spark.createDataFrame(rows, "v string, c double, s double").select("v", "c", F.avg("s").over(w).alias("m")).orderBy("v", "c").collect()]
    assert got == [0.3, 0.45, 0.6, 0.5, 0.3]


def test_null_semantics(spark):
    x = spark.createDataFrame([(None,), (5.0,), (50.0,)], "v double")
    assert [r[0] for r in derive.clip_columns(x, {"v": (10.0, 20.0)}).collect()] == [None, 10.0, 20.0]
    assert [r[0] for r in x.select(derive.flag(F.col("v") > 6)).collect()] == [False, False, True]
    assert [r[0] for r in x.select(derive.usable_event(F.col("v"), 1, 10)).collect()] == [False, True, False]


def test_landmark_panel_counts_reasons(spark):
    t = daily(spark, [("A", "2024-01-01", 60, 10.0), ("B", "2024-01-01", 60, 10.0), ("C", "2024-01-01", 60, 10.0)])
    c = spark.createDataFrame([("A", "2024-01-01", None), ("B", "2024-01-01", "2024-01-05"), ("C", None, None), ("D", "2024-01-01", None)], "vehicle_id string, s string, e string").select("vehicle_id", F.col("s").cast("timestamp").alias("sale_date"), F.col("e").cast("timestamp").alias("event_date"))
    p, why = risk.landmark_panel(t, c, [30], 10, 15, [F.sum("odo_end").alias("x")])
    assert [(r["vehicle_id"], r["n_trips"]) for r in p.collect()] == [("A", 10)]
    assert {r["reason"]: r["n"] for r in why.collect()} == {"kept": 1, "event_before": 1, "no_sale_date": 1, "no_trips": 1}
    later = t.withColumn("odo_end", F.when(F.col("t_end") > F.lit("2024-01-31").cast("timestamp"), 1e9).otherwise(F.col("odo_end")))
    assert risk.landmark_panel(later, c, [30], 10, 15, [F.sum("odo_end").alias("x")])[0].first()["x"] == p.first()["x"]


def test_kaplan_meier_by_hand(spark):
    x = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (4, 1)], "t int, e int").withColumn("g", F.lit("a"))
    got = [(r["t"], r["at_risk"], r["events"], round(r["survival"], 6)) for r in models.kaplan_meier(x, ["g"], "t", "e").orderBy("t").collect()]
    assert got == [(1.0, 5, 1, 0.8), (2.0, 4, 1, 0.6), (4.0, 1, 1, 0.0)]


def test_fleet_reference_falls_back(spark):
    rows = [(v, m, c, float(v), 1.0) for v in range(6) for m, c in (("x", "1"), ("y", "1"))] + [(9, "z", "2", 10.0, 2.0)]
    cells = spark.createDataFrame(rows, "vehicle_id long, market string, month string, value double, weight double")
    ref = models.FleetReference(5).fit(cells.filter("vehicle_id < 6"), [("cell", ["market", "month"]), ("all", [])])
    got = {r["vehicle_id"]: r["deviation"] for r in ref.transform(cells).collect()}
    assert got[0] == -2.5 and got[9] == 7.5


def test_explanations(spark):
    c = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.9), (1, "c", 0.2), (1, "d", 0.1)], "vehicle_id long, feature string, phi double")
    assert [(r["feature"], r["rank"]) for r in explain.top_contributors(c, 2).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    w = {r["step"]: round(r["phi"], 9) for r in explain.waterfall(c, 2, ["d"]).collect()}
    assert w == {"b": -0.9, "a": 0.5, "rest": 0.2, "context": 0.1}
    assert explain.stability(c, c, 2).first()[1:] == (1.0, 1.0)


def test_out_of_fold_scores_cover_every_row_once(spark):
    s = scores(spark).withColumns({"x": F.col("score"), "m": (F.col("vehicle_id") % 3).cast("string")})
    f = splits.folds(s.select("vehicle_id").distinct().withColumn("stratum", F.lit("a")), 2, 1, 5)
    out = models.run_cv(s.drop("score"), f, "logistic", ["x"], ["m"])
    assert out.count() == s.count() and out.select("vehicle_id", "cut_odo").distinct().count() == s.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())


def test_histogram_and_quantiles(spark):
    x = spark.range(0, 101).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    assert P.exact_quantiles(x, ["g"], ["v"], (0.1, 0.5)).first()[2:] == (101, 10.0, 50.0)
    h = {r["bin"]: r["n"] for r in P.histogram(x, ["g"], "v", 20, 80, 3).collect()}
    assert h == {0: 40, 1: 20, 2: 41}


def test_empty_tables_give_empty_results(spark):
    t = spark.createDataFrame([], TRIP)
    e = spark.createDataFrame([], "vehicle_id string, event_odo double")
    cuts = panel.cut_grid(t, e, 400, 100, 800, 100)
    assert cuts.count() == 0 and panel.window_rows(t, cuts, 400, 100).count() == 0
    s = scores(spark).limit(0)
    assert metrics.vehicle_levels(s, 2).count() == 0 and metrics.roc_auc(s, ["label"]).count() == 0


def test_chi_square_tail_and_likelihood_ratio(spark):
    from fleetspan.plans import models as L

    for x, df in ((3.841, 1), (5.991, 2), (7.815, 3), (9.488, 4)):
        assert abs(L.chi2_sf(x, df) - 0.05) < 1e-4
    assert L.chi2_sf(0.0, 3) == 1.0
    cells = spark.createDataFrame([(str(m), str(c), 20 * (m + 1), 1000) for m in range(3) for c in range(2)], "market string, cohort string, events long, days long")
    a, b = L.likelihood_ratio(cells, [[], ["market"], ["market", "cohort"]]).collect()
    assert a["df"] == 2 and a["p"] < 1e-6 and b["df"] == 1 and abs(b["statistic"]) < 1e-6 and b["p"] > 0.99
    assert b["aic_large"] > b["aic_small"]  # a factor without effect doesn't pay


def test_missing_categories_become_the_mode(spark):
    from fleetspan.plans import models as L

    rows = spark.createDataFrame([("a",)] * 7 + [("b",)] * 5 + [("rare",)] + [(None,)], "c string")
    out = L.RareLevels(["c"], 5)._fit(rows).transform(rows).groupBy("c", "c__r").count().collect()
    assert {(r["c"], r["c__r"]) for r in out} == {("a", "a"), ("b", "b"), ("rare", "other"), (None, "a")}


def test_matched_sample_is_the_largest(spark):
    """Against every candidate, on random cells."""
    import random

    from pyspark.sql import functions as F

    from fleetspan.plans import risk

    rng = random.Random(3)
    for trial in range(4):
        cells = {c: (rng.randint(1, 30), rng.choice((0, rng.randint(1, 60), rng.randint(1, 60)))) for c in range(5)}
        rows = [(v, c, 1, 1) for c, (r, _) in cells.items() for v in range(r)] + [(100 + v, c, 0, 0) for c, (_, h) in cells.items() for v in range(h)]
        df = spark.createDataFrame([(i, float(v), c, e, y) for i, (v, c, e, y) in enumerate(rows)], "vehicle_id long, cut_odo double, cell long, event_observed int, label int")
        all_r, best = sum(r for r, _ in cells.values()), 0
        for n in range(1, max(1, sum(h for _, h in cells.values())) + 1):
            missing = sum(max(0, round(n * r / all_r) - h) for r, h in cells.values())
            best = n if missing <= 0.1 * n else best
        want = {c: min(h, round(best * r / all_r)) for c, (r, h) in cells.items()}
        got = {r["cell"]: r["count"] for r in risk.match_healthy(df, F.col("label") == 1, ["cell"], 0.1, 3).groupBy("cell").count().collect()}
        assert got == {c: n for c, n in want.items() if n}, (trial, cells)
