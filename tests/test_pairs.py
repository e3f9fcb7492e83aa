"""Concordance counts, overlap join and nearest intervals against pairing everything."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import dedupe, joins, profile

SURV = "g int, duration double, event int, score double, entry double"


def brute_pairs(rows, entry):
    out = defaultdict(lambda: [0, 0, 0])
    for g, d, e, s, _ in rows:
        if e != 1:
            continue
        for h, d2, e2, s2, en in rows:
            if h == g and (d2 > d or d2 == d and e2 == 0) and (not entry or en is None or en < d):
                out[g][0] += 1
                out[g][1] += s > s2
                out[g][2] += s == s2
    return {g: tuple(x) for g, x in out.items()}


def survival(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        d = rng.choice([rng.uniform(1, 50), float(rng.randrange(1, 6)), 3.0])
        rows.append((rng.choice([1, 1, 1, 2]), d, rng.randrange(2), rng.choice([rng.random(), 0.5, 0.25]), rng.choice([None, rng.uniform(0, d), 0.0])))
    return rows


@pytest.mark.parametrize("leaf, single, node", [(4, 0, 64), (4, 0, 1 << 17), (16, 0, 1 << 17), (64, 1 << 12, 1 << 17)])
def test_tree_counts_every_pair_once(spark, monkeypatch, leaf, single, node):
    for name, v in (("LEAF", leaf), ("SINGLE", single), ("NODE", node)):
        monkeypatch.setattr(joins, name, v)
    rows = survival(leaf, 300)
    df = spark.createDataFrame(rows, SURV)
    got = {r["g"]: (r["n_pairs"], r["concordant"], r["ties"]) for r in joins.comparable_pairs(df, group="g", entry="entry").collect()}
    assert got == brute_pairs(rows, True)
    one = [(0, *r[1:]) for r in rows]
    r = joins.comparable_pairs(df).first()
    assert (r["n_pairs"], r["concordant"], r["ties"]) == brute_pairs(one, False)[0]


def test_rows_that_meet_one_by_one_grow_with_the_rows(spark, monkeypatch):
    """Twice the rows: leaves give at most about twice the pairs, while all pairs are four times as many. One time holds a third of the rows."""
    monkeypatch.setattr(joins, "LEAF", 8)
    monkeypatch.setattr(joins, "SINGLE", 0)
    met = []
    real = joins._met

    def counted(i, j, g):
        met[-1] += i.select("b", *g).join(j.select("b", *g), ["b", *g]).count()
        return real(i, j, g)

    monkeypatch.setattr(joins, "_met", counted)
    rng = random.Random(1)
    for n in (1000, 2000):
        met.append(0)
        rows = [(1, 5.0 if rng.random() < 1 / 3 else rng.uniform(1, 50), rng.randrange(2), rng.random(), None) for _ in range(n)]
        joins.comparable_pairs(spark.createDataFrame(rows, SURV)).collect()
    assert met[1] < 3 * met[0] and met[1] < 2000 * 4 * 8


# ---------------------------------------------------------------- overlap join


def brute_shared(rows, least):
    own = defaultdict(set)
    for v, a, b in rows:
        own[v].add((a, b))
    out = set()
    for v in own:
        for w in own:
            n = len(own[v] & own[w])
            if v < w and n and n / min(len(own[v]), len(own[w])) >= least:
                out.add((v, w, n, n / min(len(own[v]), len(own[w]))))
    return out


@pytest.mark.parametrize("least", [0.2, 0.5, 0.75, 1.0])
def test_overlaps_match_brute_force(spark, least):
    rng = random.Random(7)
    rows = [(v, rng.randrange(40), rng.choice([0, 0, 1])) for v in range(40) for _ in range(rng.randrange(1, 25))]
    rows += [(100 + c, a, b) for v, a, b in rows if v in (3, 4) for c in (v, 10 + v) if rng.random() < 0.8]  # part copies
    rows += [(v, -1, 0) for v in range(40)] + rows[:20]  # a row that all hold, and repeats
    df = spark.createDataFrame(rows, "vehicle_id long, a int, b int")
    got = [tuple(r) for r in dedupe.shared_rows(df, ["a", "b"], least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_shared(rows, least)


def test_a_popular_row_makes_no_pairs_of_its_holders(spark):
    rows = [(v, 10 * v + i, 0) for v in range(300) for i in range(6)] + [(v, -1, 0) for v in range(300)] + [(v, -2, 0) for v in range(300)]
    rows += [(1000, 10 * 5 + i, 0) for i in range(6)]
    out = dedupe.shared_rows(spark.createDataFrame(rows, "vehicle_id long, a int, b int"), ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(5, 1000, 6, 1.0)]


# ---------------------------------------------------------------- nearest interval


def test_nearest_interval_matches_brute_force(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    day = lambda x: None if x is None else t0 + dt.timedelta(days=x)
    spans = []
    for k in range(6):
        for _ in range(k * 3):
            a = rng.randrange(100)
            spans.append((k, a, rng.choice([a, a + rng.randrange(3), a + rng.randrange(60)])))
    spans += [(2, 10, 90), (2, 20, 30), (7, 50, None), (8, None, 5), (8, 40, 30)]  # nested, open, without start, backwards
    points = [(k, rng.choice([None, *range(-5, 110)])) for k in range(9) for _ in range(15)] + [(2, 25)] * 3 + [(1, s[1]) for s in spans if s[0] == 1]
    df = spark.createDataFrame([(k, day(x), i) for i, (k, x) in enumerate(points)], "vehicle_id int, at timestamp, i int")
    out = joins.min_distance(df, spark.createDataFrame([(k, day(a), day(b), 9) for k, a, b in spans], "vehicle_id int, a timestamp, b timestamp, i int"), "at")
    assert out.columns == ["vehicle_id", "at", "i", "distance_days"] and out.count() == len(points)
    for r in out.collect():
        k, x = points[r["i"]]
        d = [max(0, a - x, x - (b if b is not None else 1e9)) for q, a, b in spans if q == k and a is not None and (b is None or b >= a)] if x is not None else []
        assert r["distance_days"] == (min(d) if d else None), (k, x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert joins.min_distance(df.limit(0), spark.createDataFrame([], "vehicle_id int, a timestamp, b timestamp"), "at").count() == 0


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_counts_of_ranges(spark, levels, by):
    x = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.pow(F.col("id") % 997, F.lit(3)) / 7).alias("v"), (F.col("id") % 5).alias("c"))
    hist = x.groupBy("g" if by else F.lit(0).alias("g"), "v").agg(F.sum("c").alias("c"))
    got = joins.running_counts(hist, by, "v", ["c"], ranges=8, levels=levels).toPandas()
    want = hist.toPandas()
    assert len(got) == len(want)
    for g, rows in want.groupby("g"):
        rows = rows.sort_values("v")
        mine = got[got["g"] == g].sort_values("v")
        assert list(mine["c_below"]) == list(rows["c"].cumsum() - rows["c"]) and set(mine["c_all"]) == {rows["c"].sum()}


@pytest.mark.parametrize("levels", [1, 2])
def test_running_counts_read_in_any_order(spark, levels):
    """Every pass over the counts sees the rows in another order, as after a shuffle of several fetches; the ranges must stay."""
    n = 400_000

    def anew(batches):
        import numpy as np

        rng = np.random.default_rng()
        for b in batches:
            yield b.take(rng.permutation(b.num_rows))

    rows = spark.range(0, n, 1, 2).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("v"), F.lit(1).cast("bigint").alias("c"))
    kept = spark.conf.get("spark.sql.exchange.reuse"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        x = joins.running_counts(rows.mapInArrow(anew, rows.schema), [], "v", ["c"], levels=levels)
        got = x.agg(F.count("*"), F.sum("c_below"), F.countDistinct("c_below"), F.min("c_all"), F.max("c_all")).first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", kept[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept[1])
    assert tuple(got) == (n, n * (n - 1) // 2, n, n, n)


def test_grid_of_parameters_recomputes_no_row(spark):
    g = profile.grid(spark, a=(1, 2, 3), b=(4, 5))
    assert sorted(map(tuple, g.collect())) == [(float(a), float(b)) for a in (1, 2, 3) for b in (4, 5)] and g.rdd.getNumPartitions() == 1
    plan = spark.range(10).crossJoin(g)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
