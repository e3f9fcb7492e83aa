"""Permutations, bootstraps and nulls. Draws are orders by md5, as in splits; replicates are a dimension, not a loop."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from ..functions.columns import draw, uniform

KEY, AT = "vehicle_id", "cut_odo"


def replicates(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def placed(rows: DataFrame, order: list[Column], bucket: Column, outer: list[str] = (), name: str = "_k") -> DataFrame:
    """rows numbered from 1 within each outer group: by bucket, then by order. No task sorts a whole group: a row's number is its place
    in its bucket plus the rows of the buckets before, and only the buckets' counts are summed up in one place."""
    outer = list(outer)
    x = rows.withColumn("_b", bucket)
    n = x.groupBy(*outer, "_b").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*outer) if outer else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(*outer, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a group and bucket
    i = F.row_number().over(Window.partitionBy(*outer, "_b").orderBy(*order))
    return x.withColumn("_i", i).join(n, [*outer, "_b"]).withColumn(name, F.col("_base") + F.col("_i")).drop("_b", "_i", "_base")


def prefix(d: Column) -> Column:
    """Bucket (of 256) of a draw, in the order of the draws."""
    return F.conv(F.substring(d, 1, 2), 16, 10).cast("int")


def permute(rows: DataFrame, block: list[str], seed: int, order: list[str], within: list[str] = (), outer: list[str] = ()) -> DataFrame:
    """rows with the columns of block dealt anew among the rows of a group; order names a row within it.

    within: groups of few rows (a vehicle's), each sorted in one task. outer: groups of any size, or none for all rows; they are numbered
    in the order of a draw of their own on each side, bucket by bucket, and meet by number.
    """
    others = [c for c in rows.columns if c not in block]
    by, cols = list(within) or list(outer), [F.col(c) for c in order]
    d = draw(seed, *(F.col(c) for c in outer), *cols)
    if within:
        a = rows.select(*others).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*cols)))
        b = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(d, *cols)))
    else:
        a = placed(rows.select(*others), [draw(*cols), *cols], prefix(draw(*cols)), outer)
        b = placed(rows, [d, *cols], prefix(d), outer)
    return a.join(b.select(*by, "_k", *block), [*by, "_k"]).select(*rows.columns)


def bootstrap_weights(vehicles: DataFrame, n: int, seed: int, strata: str | None = None) -> DataFrame:
    """(replicate, vehicle_id, weight): multiplicities of vehicles drawn with replacement, as many as there are (in each stratum).

    Draw j of a replicate takes the vehicle numbered floor(u * V); vehicles are numbered once.
    """
    by = [strata] if strata else []
    v = vehicles.select(KEY, *by).distinct()
    d = draw(F.col(KEY))
    v = placed(v, [d, F.col(KEY)], prefix(d), by, "j").withColumn("j", F.col("j") - 1)
    n_all = v.groupBy(*by).agg(F.count("*").alias("V"))
    seats = replicates(v.join(n_all, by) if by else v.crossJoin(n_all), n)  # one row
    pick = F.floor(uniform(seed, F.col("replicate"), *(F.col(c) for c in by), F.col("j")) * F.col("V"))
    draws = seats.select("replicate", *by, pick.alias("j")).groupBy("replicate", *by, "j").agg(F.count("*").alias("weight"))
    return draws.join(v, [*by, "j"]).select("replicate", KEY, "weight")


def bootstrap_auc(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(replicate, auc): vehicles drawn with replacement, as weights."""
    w = bootstrap_weights(rows, n, seed)
    return M.roc_auc(rows.join(w, KEY), ["replicate"], weight="weight")


#: Poisson(1) chances that a vehicle is drawn at most 0, 1, 2, ... times: as many draws as vehicles, without a fixed total.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


def poisson_weights(vehicles: list, n: int, seed: int) -> np.ndarray:
    """Multiplicities of each vehicle (rows) in n replicates (columns). Every task makes the same from seed, replicate and vehicle."""
    u = [[int(hashlib.md5(f"{seed}|{r}|{v}".encode()).hexdigest()[:12], 16) / 2**48 for r in range(n)] for v in vehicles]
    return np.searchsorted(POISSON, np.array(u).reshape(-1, n), side="right").astype(np.float64)


#: Rows whose weights are made at once.
CHUNK = 512


def _auc_of_range(n: int, seed: int):
    """Stream of one range of (score, vehicle, p, q), sorted by score: sums of all replicates, and those of its first and last score."""
    names = ["part", "replicate", "pos", "neg", "u", *(f"{e}_{c}" for e in ("first", "last") for c in ("score", "pos", "neg"))]

    def run(batches):
        part = None
        pos, neg, u, p, q = (np.zeros(n) for _ in range(5))
        at = first = None  # the score in hand, whose sums are p and q; the first score with its sums
        for batch in batches:
            if batch.num_rows and part is None:
                part = batch.column("part")[0].as_py()
            for a in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(a, CHUNK)
                w = poisson_weights(piece.column("vehicle_id").to_pylist(), n, seed)
                s = piece.column("score").to_numpy()
                heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                ps, qs = (np.add.reduceat(w * piece.column(c).to_numpy()[:, None], heads, axis=0) for c in ("p", "q"))
                for score, x, y in zip(s[heads], ps, qs):
                    if at is not None and score != at:
                        first = first or (at, p, q)
                        u += p * (neg + q / 2)
                        pos, neg, p, q = pos + p, neg + q, np.zeros(n), np.zeros(n)
                    at, p, q = score, p + x, q + y
        if part is None:
            return
        first = first or (at, p, q)
        u += p * (neg + q / 2)
        one = lambda x: pa.array(np.full(n, x))
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, (pos + p, neg + q, u)), one(float(first[0])), *map(pa.array, first[1:]), one(float(at)), pa.array(p), pa.array(q)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run, "part int, replicate int, " + ", ".join(f"{c} double" for c in names[2:])


def poisson_auc(rows: DataFrame, n: int, seed: int, ranges: int | None = None) -> DataFrame:
    """(replicate, auc) of n bootstrap replicates over vehicles with Poisson weights, which each task makes for itself.

    A row is read and shuffled once, whatever n: a task turns its range of scores into sums for all replicates at once, and only these (a row a range
    and replicate) are put together. Vehicles are in the order that is cut into ranges, so rows of one score spread over many.
    """
    x = rows.filter("score is not null").groupBy(F.col("score").cast("double").alias("score"), KEY).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    ranges = ranges or min(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.repartitionByRange(ranges, "score", KEY).sortWithinPartitions("score").withColumn("part", F.spark_partition_id())
    run, schema = _auc_of_range(n, seed)
    # read once: another pass might cut the ranges elsewhere
    return x.mapInArrow(run, schema).groupBy("replicate").applyInArrow(_put_together, "replicate int, auc double")


def _put_together(table: pa.Table) -> pa.Table:
    """AUC of a replicate from its ranges."""
    table = table.sort_by("part")
    c = {n: table.column(n).to_numpy() for n in table.column_names}
    p, q = c["pos"].sum(), c["neg"].sum()
    u = c["u"].sum() + (c["pos"] * (np.cumsum(c["neg"]) - c["neg"])).sum()
    # a score in several ranges: its pairs across them are ties, which the sum above counted as won by the later range
    at, sum_p, sum_q = None, 0.0, 0.0
    for i in range(table.num_rows):
        for e in ("first", "last") if c["first_score"][i] != c["last_score"][i] else ("first",):
            score, x, y = (c[f"{e}_{k}"][i] for k in ("score", "pos", "neg"))
            if score != at:
                at, sum_p, sum_q = score, 0.0, 0.0
            u += (y * sum_p - x * sum_q) / 2
            sum_p, sum_q = sum_p + x, sum_q + y
    auc = u / (p * q) if p * q else None
    return pa.table({"replicate": pa.array([c["replicate"][0]], pa.int32()), "auc": pa.array([auc], pa.float64())})


def interval(draws: DataFrame, value: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval of replicates."""
    a = (1 - level) / 2
    return draws.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(a)).alias("lo"), F.percentile(value, F.lit(1 - a)).alias("hi"))


def weighted_detection(levels: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """(replicate, detection) at the budget, with weighted vehicles: tau is the healthy level at which the weight above first exceeds the budget."""
    from .joins import running_counts

    x = levels.join(weights, KEY)
    h = x.filter("event_observed = 0")
    m = h.groupBy("replicate").agg(F.floor(F.sum("weight") * budget + 1e-9).alias("m"))
    g = running_counts(h.filter("level is not null").groupBy("replicate", "level").agg(F.sum("weight").alias("w")), ["replicate"], "level", ["w"])
    above = F.col("w_all") - F.col("w_below") - F.col("w")
    tau = g.join(m, "replicate").filter((above <= F.col("m")) & (above + F.col("w") > F.col("m"))).select("replicate", F.col("level").alias("tau"))
    y = x.filter("event_observed = 1").join(tau, "replicate", "left")
    hit = F.coalesce(F.col("level") > F.coalesce("tau", F.lit(float("-inf"))), F.lit(False)).cast("double")
    return y.groupBy("replicate").agg((F.sum(hit * F.col("weight")) / F.sum("weight")).alias("detection"))


def paired_difference(a: DataFrame, b: DataFrame, n: int, budget: float, seed: int) -> DataFrame:
    """(replicate, diff): detection of levels b less that of levels a on the same draws, stratified by event."""
    w = bootstrap_weights(a, n, seed, "event_observed")
    x, y = weighted_detection(a, w, budget), weighted_detection(b, w, budget)
    return x.join(y.withColumnRenamed("detection", "other"), "replicate").select("replicate", (F.col("other") - F.col("detection")).alias("diff"))


def permutation_levels(rows: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """Levels of n permutations of all scores over all rows, which keeps every vehicle's number of cuts."""
    x = replicates(rows.select(KEY, AT, "event_observed", "score"), n)
    x = permute_replicates(x, seed)
    w = Window.partitionBy("replicate", KEY).orderBy(AT).rowsBetween(0, k - 1)
    x = x.withColumn("m", F.when(F.count("*").over(w) == k, F.min("score").over(w)))
    return x.groupBy("replicate", KEY).agg(F.max("event_observed").alias("event_observed"), F.max("m").alias("level"))


def permute_replicates(x: DataFrame, seed: int) -> DataFrame:
    """Scores permuted over all rows of each replicate."""
    return permute(x, ["score"], seed, [KEY, AT], outer=["replicate"])


def p_value(null: DataFrame, value: str, observed: DataFrame) -> DataFrame:
    """One row: (1 + draws at or above the observed value) / (1 + draws)."""
    o = observed.select(F.col(value).alias("observed"))
    return null.crossJoin(F.broadcast(o)).agg(F.first("observed").alias("observed"), F.count("*").alias("n"), ((1 + F.count_if(F.col(value) >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))  # one row
