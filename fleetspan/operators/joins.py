"""Joins of trips, vehicles and scores: m:1 enrichment, fallback lookups, interval distances, comparable pairs, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_static(rows: DataFrame, static: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Left join of a table with one row per key; columns that rows has already are not taken. Spark broadcasts static if it is small."""
    return rows.join(static.select(key, *[c for c in static.columns if c not in rows.columns]), key, "left")


def orphans(rows: DataFrame, static: DataFrame, key: str = "vehicle_id") -> DataFrame:
    return rows.join(static.select(key), key, "left_anti")


def vehicle_table(static: DataFrame, trips: DataFrame, signals: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Every vehicle of any of the three, with in_static, in_trips and in_signals."""
    mark = lambda x, n: x.withColumn(n, F.lit(True))
    x = mark(static, "in_static").join(mark(trips, "in_trips"), key, "full_outer").join(mark(signals, "in_signals"), key, "full_outer")
    return x.fillna(False, ["in_static", "in_trips", "in_signals"])


def enrichment_report(rows: DataFrame, static: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """One row: rows in and out, orphans, and keys that static holds more than once."""
    marked = static.groupBy(key).agg(F.count("*").alias("_n"))
    x = rows.select(key).join(marked, key, "left").agg(F.count("*").alias("rows_in"), F.sum(F.coalesce("_n", F.lit(1))).alias("rows_out"), F.count_if(F.col("_n").isNull()).alias("n_orphans"))
    return x.crossJoin(marked.agg(F.count_if(F.col("_n") > 1).alias("n_repeated_keys")))  # one row each


def min_distance(points: DataFrame, intervals: DataFrame, at: str, key: str = "vehicle_id") -> DataFrame:
    """points with distance_days: least distance to any interval [a, b] of the key, 0 inside; null without intervals.

    Intervals may overlap and lie in each other: of those that start up to a point the one that ends last is nearest, of those that start later
    the first. Both come from one pass over points and starts in order of time: one shuffle, and no pair of a point and an interval. An interval
    without end is open; one without start, or that ends before it starts, doesn't count.
    """
    cols = points.columns
    open_end = F.lit((1 << 63) - 1)
    starts = intervals.filter("a is not null and (b is null or b >= a)").select(key, F.unix_micros("a").alias("_x"), F.coalesce(F.unix_micros("b"), open_end).alias("_end"), F.lit(0).alias("_side"))
    both = points.withColumns({"_x": F.unix_micros(at), "_side": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("_x", "_side")
    last_end = F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_start = F.min(F.when(F.col("_side") == 0, F.col("_x"))).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = both.select(*cols, "_side", "_x", last_end.alias("_last"), next_start.alias("_next")).filter("_side = 1")
    before = F.when(F.col("_last") >= F.col("_x"), 0).otherwise(F.col("_x") - F.col("_last"))
    distance = F.when(F.col("_x").isNotNull(), F.least(before, F.col("_next") - F.col("_x")))  # least passes over a missing side
    return x.select(*cols, (distance / 86_400e6).alias("distance_days"))


def fallback_lookup(rows: DataFrame, tables: list[tuple[str, list[str], DataFrame]], value: str) -> DataFrame:
    """value and level: from the first table (name, keys, rows) with a row for the keys; a table without keys has one row for all."""
    names = []
    for name, keys, t in tables:
        t = t.select(*keys, F.col(value).alias(f"_{name}"))
        rows = rows.join(t, keys, "left") if keys else rows.crossJoin(t)  # one row
        names.append(name)
    level = reduce(lambda acc, n: F.when(F.col(f"_{n}").isNotNull(), n).otherwise(acc), reversed(names), F.lit(None).cast("string"))
    return rows.withColumns({value: F.coalesce(*(F.col(f"_{n}") for n in names)), "level": level}).drop(*(f"_{n}" for n in names))


def attach_columns(panel: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """1:1 left join; fails if extra repeats a key or misses one of panel's. The guard is one aggregate."""
    seen = extra.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = panel.select(*keys).join(seen, keys, "left").agg(F.count_if(F.coalesce("_n", F.lit(0)) != 1)).first()[0]
    if bad:
        raise ValueError(f"{bad} rows don't match exactly one row")
    return panel.join(extra, keys, "left")


def align_runs(runs: list[DataFrame], keys: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(aligned scores score_0.., one-row report of mismatches): runs joined on keys; columns same must agree."""
    out = runs[0].select(*keys, *same, F.col("score").alias("score_0"))
    for i, r in enumerate(runs[1:], 1):
        out = out.join(r.select(*keys, F.col("score").alias(f"score_{i}"), *(F.col(c).alias(f"_{c}_{i}") for c in same)), keys, "full_outer")
    wrong = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}_{i}")) for i in range(1, len(runs)) for c in same], F.lit(False))
    report = out.agg(F.count("*").alias("n_rows"), F.count_if(wrong).alias("n_mismatch"))
    return out.select(*keys, *same, *(f"score_{i}" for i in range(len(runs)))), report


def reference_deviation(rows: DataFrame, cells: list[str], value: str, healthy: Column) -> DataFrame:
    """deviation of value from the mean of healthy rows in the same cell; cells have few keys."""
    ref = rows.filter(healthy).groupBy(*cells).agg(F.avg(value).alias("_ref"))
    return rows.join(ref, cells, "left").withColumn("deviation", F.col(value) - F.col("_ref")).drop("_ref")


#: Rows of a leaf of the order-statistic tree, which meet one by one.
LEAF = 64
#: Groups of up to so many rows are one leaf.
SINGLE = 1 << 12
#: Groups and nodes of up to so many rows are summed by a window, larger ones range by range.
NODE = 1 << 17


def comparable_pairs(rows: DataFrame, score: str = "score", group: str | None = None, entry: str | None = None) -> DataFrame:
    """Counts (n_pairs, concordant, ties) of pairs (event row i, row j at risk at i's time) by group.

    i has event = 1; j is comparable if it lasts longer than i, or as long without an event, and has entered before i's time. As no row
    leaves before it enters, those are the rows that last longer, less those that enter at i's time or later: two counts of _dominated.
    """
    g = [group] if group else []
    base = rows.groupBy(*g, "duration", "event", F.col(score).cast("double").alias("s"), (F.col(entry) if entry else F.lit(None).cast("double")).cast("double").alias("entry")).agg(F.count("*").alias("w")).persist()  # read several times
    most = base.groupBy(*g).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]  # says how large nodes become
    i = base.filter("event = 1").groupBy(*g, F.col("duration").cast("double").alias("x"), "s").agg(F.sum("w").alias("wi")).withColumn("k", F.lit(1))
    # at equal times, k tells which rows come after i
    longer = base.select(*g, F.col("duration").cast("double").alias("x"), F.when(F.col("event") == 0, 2).otherwise(0).alias("k"), "s", "w")
    late = base.filter("entry is not null").select(*g, F.col("entry").alias("x"), F.when((F.col("event") == 1) & (F.col("entry") >= F.col("duration")), 0).otherwise(2).alias("k"), "s", "w")
    a = _dominated(i, longer, g, 2 * most)
    if entry:
        a = a.unionByName(_dominated(i, late, g, 2 * most).select(*g, *((-F.col(c)).alias(c) for c in ("n", "less", "same"))))
    return a.groupBy(*g).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("n", "n_pairs"), ("less", "concordant"), ("same", "ties")))).filter("n_pairs > 0")


def _dominated(i: DataFrame, j: DataFrame, g: list[str], most: int) -> DataFrame:
    """(g, n, less, same): weights of pairs with (x, k) of j after that of i; in all, with a smaller score than i's, with the same.

    An order-statistic tree over the places of (x, k): leaves hold up to 2 * LEAF rows, or all rows of one (x, k), which can't be pairs. All
    leaves after i's are the right neighbours of the nodes above it, so j is counted in its nodes' histograms of scores, and i looks up one node
    a level at most: rows times levels, which follow the logarithm of the group's rows. Only rows of one leaf meet one by one.
    most: rows of the largest group at most.
    """
    if g and most <= SINGLE:
        return _met(i.withColumn("b", F.lit(0)), j.withColumn("b", F.lit(0)), g)
    both = i.select(*g, "x", "k", "s", "wi", F.lit(0).cast("bigint").alias("w")).unionByName(j.select(*g, "x", "k", "s", F.lit(0).cast("bigint").alias("wi"), "w"))
    ks = [F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(3)]
    at = both.groupBy(*g, "x").agg(F.count("*").alias("n"), *ks)
    at = running_counts(at, g, "x", ["n"]) if most > NODE else _windowed_counts(at, g, "x", ["n"])
    # (x, k) with more than LEAF rows is the last of its block, and a leaf of its own
    order = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("size"), (F.col("n_below") + sum((F.col(f"n{q}") for q in range(k)), F.lit(0))).alias("below")) for k in range(3))))
    leaf = 2 * F.floor(F.col("o.below") / LEAF) + (F.col("o.size") > LEAF).cast("int")
    levels = F.ceil(F.log2(2 * F.floor(F.col("n_all") / LEAF) + 2)).cast("int")
    places = at.select(*g, "x", levels.alias("levels"), order.alias("o")).filter("o.size > 0").select(*g, "x", "o.k", leaf.alias("b"), "levels")
    placed = both.join(places, [*g, "x", "k"]).persist()  # read by nodes and by leaves
    up = F.explode(F.sequence(F.lit(0), F.col("levels") - 1))
    node = F.expr("shiftright(b, level)")
    x = placed.withColumn("level", up).withColumn("node", node)
    jn = x.filter("w > 0 and node % 2 = 1").select(*g, "level", "node", "s", "w", F.lit(0).cast("bigint").alias("wi"))
    it = x.filter("wi > 0 and node % 2 = 0").select(*g, "level", F.col("node") + 1, "s", F.lit(0).cast("bigint").alias("w"), "wi")
    # what i looks up stands in the histogram itself
    h = jn.union(it).groupBy(*g, "level", "node", "s").agg(F.sum("w").alias("w"), F.sum("wi").alias("wi"))
    key = [*g, "level", "node"]
    small = F.pow(F.lit(2.0), F.col("level")) * LEAF <= NODE
    found = _windowed_counts(h.filter(small), key, "s", ["w"])
    if most > NODE:
        found = found.unionByName(running_counts(h.filter(~small), key, "s", ["w"]))
    far = found.filter("wi > 0").select(*g, (F.col("wi") * F.col("w_all")).alias("n"), (F.col("wi") * F.col("w_below")).alias("less"), (F.col("wi") * F.col("w")).alias("same"))
    one = placed.filter("b % 2 = 0")
    return far.unionByName(_met(one.filter("wi > 0"), one.filter("w > 0").drop("wi"), g))


def _met(i: DataFrame, j: DataFrame, g: list[str]) -> DataFrame:
    """The sums of _dominated for rows of one leaf b, one by one."""
    a = i.select(*g, "b", F.col("x").alias("xi"), F.col("k").alias("ki"), F.col("s").alias("si"), "wi")
    after = (F.col("x") > F.col("xi")) | ((F.col("x") == F.col("xi")) & (F.col("k") > F.col("ki")))
    pair = F.col("wi") * F.col("w")
    less, same = (F.sum(F.when(c, pair).otherwise(0)) for c in (F.col("s") < F.col("si"), F.col("s") == F.col("si")))
    return a.join(j, [*g, "b"]).filter(after).groupBy(*g).agg(F.sum(pair).alias("n"), less.alias("less"), same.alias("same"))


def score_drift(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row comparing two score tables: rows, greatest difference, equal scores, equal ranks, rank correlation."""
    x = a.select(*keys, F.col("score").alias("sa")).join(b.select(*keys, F.col("score").alias("sb")), keys)
    for s in ("sa", "sb"):
        x = average_rank(x, s, f"r{s}")
    return x.agg(F.count("*").alias("n_rows"), F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_abs_diff"), F.count_if(F.col("sa") == F.col("sb")).alias("n_equal"), F.count_if(F.col("rsa") == F.col("rsb")).alias("n_rank_equal"), F.corr("rsa", "rsb").alias("rho"))


def average_rank(rows: DataFrame, score: str, name: str, by: list[str] = (), share: bool = False) -> DataFrame:
    """Rank from 1 with ties at their mean, or as share of the rows. Ranks come from counts of distinct scores, not from one sorted partition of rows.

    The running sum runs over distinct scores in ranges: each range sums by itself and adds the total of the ranges before.
    """
    by = list(by)
    n = rows.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = running_counts(n, by, "_s", ["_n"])
    mean = F.col("_n_below") + (F.col("_n") + 1) / 2.0
    ranked = ranked.withColumn(name, mean / F.col("_n_all") if share else mean).select(*(F.col(c).alias(f"_k_{c}") for c in by), "_s", name)
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col(score).eqNullSafe(F.col("_s")))
    return rows.join(ranked, cond, "left").drop("_s", *(f"_k_{c}" for c in by))


def _windowed_counts(hist: DataFrame, by: list[str], value: str, counts: list[str]) -> DataFrame:
    """running_counts of groups that one task can sort."""
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = every.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return hist.select(*hist.columns, *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in counts), *(F.sum(c).over(every).alias(f"{c}_all") for c in counts))


#: Values of a group that its cuts are taken from, at most.
CUT_SAMPLE = 1 << 12


def range_cuts(hist: DataFrame, by: list[str], value: str, ranges: int) -> DataFrame:
    """(by, _q): cuts of a group's values into about equal ranges: exact quantiles of up to CUT_SAMPLE values, those of least hash in as many classes of hashes.

    Whoever deals rows to ranges reads them more than once, and each pass must find the same ranges: these depend on the values alone. The cuts of a
    sketch depend on the order in which its parts arrive, so that totals of one pass don't belong to the ranges of another.
    """
    h = F.xxhash64(value)
    some = hist.groupBy(*by, F.pmod(h, F.lit(CUT_SAMPLE)).alias("_h")).agg(F.min_by(value, h).alias("_s"))
    return some.groupBy(*by).agg(F.percentile("_s", F.array(*(F.lit(i / ranges) for i in range(1, ranges)))).alias("_q"))


def running_counts(hist: DataFrame, by: list[str], value: str, counts: list[str], ranges: int = 64, levels: int | None = None) -> DataFrame:
    """hist with <c>_below (sum of c over smaller values of the group) and <c>_all. Values are dealt to ranges by range_cuts.

    No group is sorted in one task: the window runs within a range, and ranges are put together by their totals (a row a range). Where the session
    has more than 4 * ranges shuffle partitions, each range is cut into as many once more, so that ranges follow the cluster; levels sets it otherwise.
    """
    levels = levels or (2 if int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 4 * ranges else 1)
    x, within = hist, []
    for level in range(levels):
        q = range_cuts(x, [*by, *within], value, ranges)
        x = x.join(q, [*by, *within]) if by or within else x.crossJoin(q)  # one row
        x = x.withColumn(f"_r{level}", F.coalesce(F.size(F.filter("_q", lambda e: e < F.col(value))), F.lit(0))).drop("_q")
        within.append(f"_r{level}")
    parts = x.groupBy(*by, *within).agg(*(F.sum(c).alias(f"_p_{c}") for c in counts))
    w = Window.partitionBy(*by).orderBy(*within) if by else Window.orderBy(*within)
    every = Window.partitionBy(*by) if by else Window.partitionBy()
    parts = parts.select(*by, *within, *(F.coalesce(F.sum(f"_p_{c}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{c}") for c in counts), *(F.sum(f"_p_{c}").over(every).alias(f"{c}_all") for c in counts))
    inner = Window.partitionBy(*by, *within).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(parts, [*by, *within])
    return x.select(*hist.columns, *((F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(f"{c}_below") for c in counts), *(f"{c}_all" for c in counts))


def matrix(tables: list[DataFrame], key: str = "vehicle_id") -> DataFrame:
    """Chained left joins on the key; a column that is there already isn't taken again."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(key, *[c for c in t.columns if c not in out.columns]), key, "left")
    return out


def code_transition(a: DataFrame, b: DataFrame, key: str, attribute: str) -> DataFrame:
    x = a.select(key, F.col(attribute).alias("before")).join(b.select(key, F.col(attribute).alias("after")), key, "full_outer")
    return x.groupBy("before", "after").agg(F.count("*").alias("n"), F.count_if(F.col("before").eqNullSafe(F.col("after"))).alias("n_same"))


class LeakError(ValueError):
    """Raised by guards."""


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "vehicle_id") -> None:
    hit = a.select(key).join(b.select(key), key, "left_semi").limit(1).collect()
    if hit:
        raise LeakError(f"{key} {hit[0][0]} is on both sides")


def assert_subset(rows: DataFrame, allowed: DataFrame, key: str = "vehicle_id") -> None:
    hit = rows.select(key).join(allowed.select(key), key, "left_anti").limit(1).collect()
    if hit:
        raise LeakError(f"{key} {hit[0][0]} isn't allowed")


def assert_columns_absent(rows: DataFrame, forbidden: list[str]) -> None:
    hit = [c for c in rows.columns if c in forbidden]
    if hit:
        raise LeakError(f"forbidden columns: {hit}")
