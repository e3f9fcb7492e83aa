"""Exact quantiles of groups of any size, by selection: no group is held, sorted or ranked in one task.

1. One pass over the rows gives each group its size and a quantile sketch. Around each wanted rank the sketch sets a bracket of values that holds it.
2. A second pass counts rows below each bracket and, value by value, those inside. Both are partial aggregates, so a group that holds a third of
   all rows is summed up where its rows are. Groups with few rows have one bracket around everything.
3. Running counts of the distinct values inside, put together from ranges, find the values at the ranks.

Where a count finds no group of more than PLAIN rows, Spark's own percentile is taken: its buffers are bounded then.

That a bracket holds its rank follows from the sketch's error bound and is checked by the exact counts: a miss is an error, never a wrong value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import running_counts

#: The sketch's ranks are off by a 10,000th of the rows at most.
ACCURACY = 10_000
#: Half a bracket, as a share of the rows: the sketch's error, two ranks of a group of SMALL rows, and as much again.
MARGIN = 4e-4
#: Groups with fewer rows are counted whole.
SMALL = 2 * ACCURACY
#: Where no group has more rows, one buffer a group is small enough.
PLAIN = 1 << 16
#: Up to so many groups, a row each, are kept by the driver between the passes.
GROUPS = 20_000


def _bracketed(value: str, probs: list[float]) -> Column:
    """(lo, hi) around each of probs."""
    ends = [min(1.0, max(0.0, x)) for p in probs for x in (p - MARGIN, p + MARGIN)]
    some = F.percentile_approx(value, F.array(*(F.lit(e) for e in ends)), F.lit(ACCURACY))
    small = F.count(value) < SMALL
    lo = lambda i, p: F.when(small | F.lit(p <= MARGIN), F.min(value)).otherwise(some[2 * i])
    hi = lambda i, p: F.when(small | F.lit(p >= 1 - MARGIN), F.max(value)).otherwise(some[2 * i + 1])
    return F.array(*(F.struct(lo(i, p).alias("lo"), hi(i, p).alias("hi")) for i, p in enumerate(probs)))


def quantiles(rows: DataFrame, by: list[str], wanted: list[tuple[str, Column | str, float]], aggs: list[Column] = (), few_groups: bool = True) -> DataFrame:
    """One row per group: by, aggs, and a column for each (name, numeric column, share in [0, 1]) of wanted, with linear interpolation between ranks.

    Nulls don't count; a group without values has null. aggs are further aggregates of the same first pass. few_groups: the groups are few by
    construction (metrics, cohorts, bins of a scale), so a row a group may be broadcast; with False, or with more than GROUPS of them, rows are joined
    to their groups by a shuffle. The first pass runs at once: what follows must see the same brackets wherever it reads them.
    """
    columns: dict[str, Column] = {}
    at = []  # (name, index of its column, place among the column's probs)
    probs: list[list[float]] = []
    for name, x, p in wanted:
        x = F.col(x) if isinstance(x, str) else x
        if str(x) not in columns:
            columns[str(x)] = x
            probs.append([])
        c = list(columns).index(str(x))
        if p not in probs[c]:
            probs[c].append(p)
        at.append((name, c, p))
    if (rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= PLAIN:
        return rows.groupBy(*by).agg(*aggs, *(F.percentile((F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(float(p))).alias(name) for name, x, p in wanted))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    values = [f"_v{c}" for c in range(len(columns))]
    valued = rows.withColumns({v: x.cast("double") for v, x in zip(values, columns.values())})
    first = valued.groupBy(*by).agg(*aggs, *(F.count(v).alias(f"_n{c}") for c, v in enumerate(values)), *(_bracketed(v, probs[c]).alias(f"_b{c}") for c, v in enumerate(values))).withColumn("_g", group)
    some = first.limit(GROUPS + 1).collect() if few_groups else []
    few_groups = few_groups and len(some) <= GROUPS
    first = rows.sparkSession.createDataFrame(some, first.schema) if few_groups else first.persist()
    small = F.broadcast if few_groups else (lambda t: t)

    # the second pass: a row a group, column and value inside a bracket, and one for all values outside
    most = max(map(len, probs))
    each = valued.select(group.alias("_g"), F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(v).alias("_v")) for c, v in enumerate(values)))).alias("_x")).select("_g", "_x.*").filter("_v is not null")
    brackets = first.select("_g", F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(f"_b{c}").alias("_b")) for c in range(len(values))))).alias("_x")).select("_g", "_x.*")
    hit = F.array_position(F.transform("_b", lambda b: F.col("_v").between(b["lo"], b["hi"])), True)
    marked = each.join(small(brackets), ["_g", "_c"]).withColumn("_j", hit.cast("int"))
    below = [F.count_if((F.col("_j") == 0) & (F.col("_v") < F.get("_b", F.lit(j))["lo"])).alias(f"_below{j}") for j in range(most)]
    counts = marked.groupBy("_g", "_c", "_j", F.when(F.col("_j") > 0, F.col("_v")).alias("_in")).agg(F.count("*").alias("_n"), *below)
    outside = counts.filter("_j = 0").select("_g", "_c", F.array(*(f"_below{j}" for j in range(most))).alias("_below"))
    inside = running_counts(counts.filter("_j > 0").select("_g", "_c", "_j", "_in", "_n"), ["_g", "_c"], "_in", ["_n"])

    # ranks of the values inside: those below among them, and those outside below their bracket
    placed = inside.join(small(outside), ["_g", "_c"], "left").withColumn("_from", F.col("_n_below") + F.coalesce(F.get("_below", F.col("_j") - 1), F.lit(0)))
    sizes = first.select("_g", F.array(*(f"_n{c}" for c in range(len(values)))).alias("_sizes"))
    placed = placed.join(small(sizes), "_g")
    place = lambda p: (F.get("_sizes", F.col("_c")) - 1) * F.lit(p)
    found = []
    for c, p in sorted({(c, p) for _, c, p in at}):
        for end, rank in (("lo", F.floor(place(p))), ("hi", F.ceil(place(p)))):
            holds = (F.col("_c") == c) & (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))
            found.append(F.max(F.when(holds, F.col("_in"))).alias(f"_{end}{c}_{probs[c].index(p)}"))
    picked = placed.groupBy("_g").agg(*found)
    out = first.join(small(picked), "_g", "left")

    def value(c: int, p: float) -> Column:
        k = f"{c}_{probs[c].index(p)}"
        x = (F.col(f"_n{c}") - 1) * F.lit(p)
        lo, hi = F.floor(x), F.ceil(x)
        both = F.when(lo == hi, F.col(f"_lo{k}")).otherwise((hi - x) * F.col(f"_lo{k}") + (x - lo) * F.col(f"_hi{k}"))
        missed = F.col(f"_lo{k}").isNull() | F.col(f"_hi{k}").isNull()
        return F.when(F.col(f"_n{c}") == 0, None).when(missed, F.raise_error(F.lit("quantiles: a bracket missed its rank")).cast("double")).otherwise(both)

    kept = [x for x in first.columns if x != "_g" and x not in {f"_{k}{c}" for k in "nb" for c in range(len(values))}]
    return out.select(*kept, *(value(c, p).alias(name) for name, c, p in at))
