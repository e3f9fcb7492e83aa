"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, met, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size")), "stars")
    return met(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # every edge runs from its larger to its smaller end
    low = stored(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "stars")
    again = met(e, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return again.union(low.select("u", F.col("m").alias("v"))).distinct()


def _ended(e: DataFrame) -> bool:
    """Whether every edge leads from a node without other edges to the middle of a star."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that a link names. Ids on no link aren't listed.

    Nulls and links of an id to itself are left out; order and repeats of links don't matter. Each round is written to the
    shared folder, and the one before deleted; nothing but whether all are stars comes to the driver. The centre of a large star
    is a hot key, which ``met`` keeps out of the shuffle.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = stored(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _ended(e):
            break
        large = stored(_large_star(e), "edges")
        new = stored(_small_star(large), "edges")
        discard(e, large)
        e = new
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("id"), "component").distinct())
