"""Window features from panes against plain aggregates of each window's rows."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.plans import panel, panes

TRIP = "vehicle_id long, event_id long, odo_end double, trip_km double, t_start timestamp, t_end timestamp, x double, ev int, message string"
T0 = dt.datetime(2024, 1, 1)


def make_trips(seed, vehicles=4, n=60):
    rng, rows = random.Random(seed), []
    for v in range(vehicles):
        odo, t = 0.0, T0
        for i in range(n if v else 3):
            km = rng.choice([0.0, 0.0, 12.5, 25.0, 50.0, 7.31, 400.0 if rng.random() < 0.1 else 3.0])
            odo, t = round(odo + km, 2), t + dt.timedelta(hours=rng.randrange(1, 50))
            rows.append((v, 1000 * v + i, odo, km, t, t + dt.timedelta(minutes=30), rng.choice([None, rng.uniform(-5, 5), 1.5]), int(rng.random() < 0.4), rng.choice(["error", "view"])))
        rows.append((v, 1000 * v + n, None, 1.0, t, t, 99.0, 1, "error"))  # no place
    return rows


def brute(rows, cuts, window):
    out = {}
    for v, c in cuts:
        own = sorted((r for r in rows if r[0] == v and r[2] is not None), key=lambda r: (r[2], r[4], r[1]))
        prev, w = None, []
        for r in own:
            if c - window < r[2] <= c:
                w.append((*r, prev))
            if r[7] > 0:
                prev = r[2]
        if not w:
            continue
        val = lambda rs: [r[6] for r in rs if r[6] is not None]
        late, early = [r for r in w if r[2] > c - window / 2], [r for r in w if r[2] <= c - window / 2]
        ev = [r for r in w if r[7] > 0]
        gaps = lambda rs: [r[2] - r[9] for r in rs if r[7] > 0 and r[9] is not None and r[9] > c - window]
        q = lambda a, p: float(np.quantile(a, p)) if a else None
        km = sum(max(r[3], 0) for r in w)
        days = max((max(r[5] for r in w) - min(r[4] for r in w)).total_seconds() / 86400, 1.0)
        half = statistics.median(val(late)) - statistics.median(val(early)) if len(val(late)) >= 3 and len(val(early)) >= 3 else None
        mean = lambda a: sum(a) / len(a) if a else None
        a, b = mean(val(late)), mean(val(early))
        count = (sum(r[7] for r in late) - sum(r[7] for r in early)) / (window / 2) * 1000
        g_late, g_early = q(gaps(late), 0.5), q(gaps(early), 0.5)
        out[v, c] = {
            "mean": mean(val(w)), "median": q(val(w), 0.5), "max": max(val(w), default=None), "min": min(val(w), default=None), "std": statistics.stdev(val(w)) if len(val(w)) > 1 else None,
            "p25": q(val(w), 0.25), "p75": q(val(w), 0.75), "sum": sum(val(w)) if val(w) else None, "count": len(val(w)), "any": float(any(r[7] > 0 for r in w)),
            "per_1000km": sum(r[7] for r in w) / km * 1000 if km else None, "per_day": sum(r[7] for r in w) / days, "half_delta": half, "half_slope_per_1000km": half / (window / 2) * 1000 if half is not None else None,
            "half_mean_delta": a - b if a is not None and b is not None else None, "half_count_delta_per_1000km": count,
            "gap_mean_km": (max(r[2] for r in ev) - min(r[2] for r in ev)) / (len(ev) - 1) if len(ev) > 1 else None, "gap_median_km": q(gaps(w), 0.5) if len(ev) > 1 else None,
            "gap_trend_km": g_late - g_early if len(ev) > 3 and g_late is not None and g_early is not None else None, "km_since_last": c - max(r[2] for r in ev) if ev else None, "rows": len(w),
        }
    return out


SPECS = [(a, "ev" if a in ("any", "per_1000km", "per_day", "half_count_delta_per_1000km", "km_since_last") or a.startswith("gap") else "x", a) for a in panes.AGGREGATORS]


@pytest.mark.parametrize("window, step", [(400.0, 100.0), (250.0, 100.0), (75.0, 25.0), (100.0, 40.0)])
def test_panes_equal_plain_windows(spark, window, step):
    rows = make_trips(int(window))
    cuts = [(v, c * step) for v in range(5) for c in range(1, int(700 / step))]
    trips = panel.with_prev_event(spark.createDataFrame(rows, TRIP), F.col("ev") > 0)
    out = panes.features(trips, spark.createDataFrame(cuts, "vehicle_id long, cut_odo double"), SPECS, window, step, extra=lambda f: {"rows": f.rows()}).collect()
    want = brute(rows, cuts, window)
    assert {(r["vehicle_id"], r["cut_odo"]) for r in out} == set(want)
    for r in out:
        for name, x in want[r["vehicle_id"], r["cut_odo"]].items():
            assert (r[name] is None) == (x is None) and (x is None or math.isclose(r[name], x, rel_tol=1e-9, abs_tol=1e-9)), (name, r[name], x)


def test_nothing_after_the_cut_counts_and_empty_windows_stay(spark):
    cuts = spark.createDataFrame([(0, 100.0), (1, 200.0), (9, 100.0)], "vehicle_id long, cut_odo double")
    rows = make_trips(3, 2)
    f = lambda rs: sorted(map(tuple, panes.features(spark.createDataFrame(rs, TRIP), cuts, [("m", "x", "median"), ("n", "x", "count")], 100.0, 100.0, empty=True).collect()))
    later = [(*r[:6], 1e9, *r[7:]) if r[2] is not None and r[2] > (100 if r[0] == 0 else 200) else r for r in rows]
    assert f(rows) == f(later) and (9, 100.0, None, 0) in f(rows)
    assert panes.features(spark.createDataFrame([], TRIP), cuts, [("m", "x", "mean")], 100.0, 100.0).count() == 0


def test_a_user_adds_an_aggregator(spark, monkeypatch):
    monkeypatch.setitem(panes.AGGREGATORS, "spread", lambda f, x: f"{f.max(x)} - {f.min(x)}")
    rows, cuts = make_trips(8, 2), [(1, 100.0), (1, 200.0)]
    out = panes.features(spark.createDataFrame(rows, TRIP), spark.createDataFrame(cuts, "vehicle_id long, cut_odo double"), [("s", "x", "spread")], 100.0, 100.0).collect()
    want = brute(rows, cuts, 100.0)
    assert out and all(r["s"] == want[r["vehicle_id"], r["cut_odo"]]["max"] - want[r["vehicle_id"], r["cut_odo"]]["min"] for r in out)


def test_rows_dealt_by_vehicle_are_not_shuffled_again(spark):
    cuts = spark.createDataFrame([(1, 100.0)], "vehicle_id long, cut_odo double").repartition(4, "vehicle_id")
    trips = spark.createDataFrame(make_trips(1), TRIP).repartition(4, "vehicle_id")
    out = panes.features(trips, cuts, SPECS[:8], 400.0, 100.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one a side, as dealt


def test_deviation_from_history(spark):
    rows = [(1, i, 10.0 * i, 10.0, T0, T0, float(i), 0, "view") for i in range(1, 101)]
    cuts = spark.createDataFrame([(1, 400.0), (1, 1000.0)], "vehicle_id long, cut_odo double")
    out = {r["cut_odo"]: r["deviation"] for r in panes.deviation(spark.createDataFrame(rows, TRIP), cuts, "x", 1000.0, 400.0, 100.0, 300).collect()}
    assert out == {400.0: None, 1000.0: pytest.approx(sum(range(1, 61)) / 60 - sum(range(61, 101)) / 40)}


def test_pane_width():
    assert panes.pane_width(100, 400, 200) == 100 and panes.pane_width(100, 250, 125) == 25 and panes.pane_width(0.5, 0.75) == 0.25


def test_channels(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 0), (1, 25.0, 3.0, 1), (1, 25.1, None, 0), (1, None, 9.0, 1)], "vehicle_id long, odo_end double, x double, ev int")
    out = panes.channels(rows, 25.0, [("m", "x", "mean"), ("n", "*", "count"), ("a", "ev", "any")]).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 2.0, 2, 1), (1, 1, None, 1, 0)]


def test_history_of_just_enough_km_counts_whatever_the_order(spark):
    """Trips of 300.00 km in all, whose sums in doubles differ by their last bits."""
    import random

    from fleetspan.plans import panes

    rng, rows = random.Random(1), []
    for v in range(1000):
        cents = [rng.randrange(1000, 4000) for _ in range(9)]
        cents.append(30000 - sum(cents))
        for i in range(10):
            rows.append((v, sum(cents[: i + 1]) / 100.0 + 200.0, cents[i] / 100.0, 50.0))
        rows.append((v, 700.0, 10.0, 40.0))
    trips = spark.createDataFrame(rows, "vehicle_id long, odo_end double, trip_km double, x double")
    cuts = trips.select("vehicle_id").distinct().selectExpr("vehicle_id", "1000D as cut_odo")
    for least, n in ((300, 1000), (300.01, 0)):
        assert panes.deviation(trips, cuts, "x", 1000.0, 400.0, 100.0, least).filter("deviation = 10").count() == n


@pytest.mark.parametrize("name", ["b02_full_panel", "b07_history_panel", "g23_history_deviation", "g24_window_quality"])
def test_distances_at_a_threshold_are_those_of_the_sql(spark, tmp_path, name):
    """Windows of 320.00 km and histories of 300.00 km, some of which fall short in doubles that are added trip by trip."""
    import duckdb

    from fleetspan.queries import load

    rng, rows = random.Random(2), []
    for v in range(400):
        total, n = (32000, 8) if v % 2 else (30000, 10)
        cents = [rng.randrange(6000, 9000), *(rng.randrange(1000, 3000) for _ in range(n - 2))]
        for x in [5000, *cents, total - sum(cents), 40000 if total == 30000 else 20000, 135000]:
            rows.append((len(rows), 3 * v + 1, "click", x / 100.0, f'{{"k": {rng.randrange(100)}}}'))
    # a deviation of 13 / 32 - 7 / 5, which lies half a unit of the fourth place from what it is rounded to
    for km, level in [(100, 0), *((15, int(i < 13)) for i in range(32)), (150, 7), *[(50, 0)] * 4, (300, 0), (1000, 0)]:
        rows.append((len(rows), 1201, "click", float(km), f'{{"k": {level}}}'))
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, event_id) as ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1, 1202).selectExpr("id as c_custkey", "id % 25 as c_nationkey", "'A' as c_mktsegment", "0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    duck, (queries, sql) = duckdb.connect(), load()
    duck.sql("set timezone='UTC'")
    for t in ("events", "customer"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = queries[name](spark, str(tmp_path)), duck.sql(sql[name])
    want = [tuple(map(str, r)) for r in want.select(*got.columns).fetchall()]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(want)
