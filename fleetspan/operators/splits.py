"""Grouped, stratified splits by vehicle. Every draw is an order by md5(seed | repeat | key), so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw
from .resample import placed, prefix

KEY = "vehicle_id"


def composite_strata(vehicles: DataFrame, levels: list[str], least: int) -> DataFrame:
    """stratum: the longest prefix of the levels, joined by '|', that at least so many vehicles share; 'all' if none."""
    x = vehicles
    for i in range(1, len(levels) + 1):
        x = x.withColumn(f"_n{i}", F.count("*").over(Window.partitionBy(*levels[:i])))
    s = F.lit("all")
    for i in range(1, len(levels) + 1):
        s = F.when(F.col(f"_n{i}") >= least, F.concat_ws("|", *(F.col(c).cast("string") for c in levels[:i]))).otherwise(s)
    return x.withColumn("stratum", s).drop(*(f"_n{i}" for i in range(1, len(levels) + 1)))


def stratify(rows: DataFrame, label: str) -> DataFrame:
    """One row per vehicle: its greatest label and how many distinct values it has."""
    return rows.groupBy(KEY).agg(F.max(label).alias("stratum"), F.countDistinct(label).alias("n_values"))


def folds(vehicles: DataFrame, k: int, repeats: int, seed: int, stratum: str = "stratum") -> DataFrame:
    """(repeat, fold, vehicle_id): within each stratum vehicles are dealt round in the order of the draw."""
    x = vehicles.select(KEY, stratum).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = draw(seed, F.col("repeat"), F.col(KEY))
    x = placed(x, [d, F.col(KEY)], prefix(d), ["repeat", stratum])
    return x.select("repeat", ((F.col("_k") - 1) % k).cast("int").alias("fold"), KEY)


def extend_folds(old: DataFrame, vehicles: DataFrame, k: int, seed: int, stratum: str = "stratum") -> DataFrame:
    """Old assignments stay; new vehicles go to the emptiest folds of their stratum, in the order of the draw."""
    v = vehicles.select(KEY, stratum)
    have = old.join(v, KEY)
    counts = have.groupBy("repeat", stratum, "fold").agg(F.count("*").alias("n"))
    spine = old.select("repeat").distinct().crossJoin(v.select(stratum).distinct()).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))  # repeats by strata
    seats = spine.join(counts, ["repeat", stratum, "fold"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    new = v.join(old.select(KEY).distinct(), KEY, "left_anti").join(F.broadcast(old.select("repeat").distinct()))
    d = draw(seed, F.col("repeat"), F.col(KEY))
    new = placed(new, [d, F.col(KEY)], prefix(d), ["repeat", stratum], "j")
    need = new.groupBy("repeat", stratum).agg(F.max("j").alias("m"))
    # seats of a fold are numbered by how full it would be; the emptiest seats come first
    seats = seats.join(need, ["repeat", stratum]).withColumn("level", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("m") - 1)))
    order = Window.partitionBy("repeat", stratum).orderBy("level", "fold")
    seats = seats.withColumn("j", F.row_number().over(order)).filter("j <= m")
    dealt = new.join(seats.select("repeat", stratum, "j", "fold"), ["repeat", stratum, "j"]).select("repeat", "fold", KEY)
    return old.select("repeat", "fold", KEY).unionByName(dealt)


def holdout(vehicles: DataFrame, k: int, seed: int, stratum: str = "stratum") -> DataFrame:
    """(vehicle_id, side): one fold of k is test."""
    return folds(vehicles, k, 1, seed, stratum).select(KEY, F.when(F.col("fold") == 0, "test").otherwise("dev").alias("side"))


def restrict(sides: DataFrame, universe: DataFrame) -> DataFrame:
    """Frozen sides; vehicles outside the universe are excluded, none is drawn again."""
    u = universe.select(KEY).distinct().withColumn("_in", F.lit(True))
    return sides.join(u, KEY, "left").select(KEY, F.when(F.col("_in"), F.col("side")).otherwise("excluded").alias("side"))


def extend_holdout(sides: DataFrame, vehicles: DataFrame, k: int, seed: int, stratum: str = "stratum") -> DataFrame:
    """Nobody moves; vehicles without a side are drawn among themselves."""
    return sides.select(KEY, "side").unionByName(holdout(vehicles.join(sides.select(KEY), KEY, "left_anti"), k, seed, stratum))


def apply_sides(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """rows with side: dev, test, excluded or unknown."""
    return rows.join(sides.select(KEY, "side"), KEY, "left").withColumn("side", F.coalesce("side", F.lit("unknown")))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: rows, vehicles and a digest of the sorted ids, put together from digests of blocks of ids."""
    ids = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    blocks = ids.groupBy(F.floor(F.col(KEY) / 4096).alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(KEY)), lambda x: x.cast("string")), ","), 256).alias("d"))
    return blocks.agg(F.sum("n").alias("n_rows"), F.sum("v").alias("n_vehicles"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), ","), 256).alias("digest"))


def same_folds(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of either that the other lacks."""
    cols = ["repeat", "fold", KEY]
    x = a.select(*cols).withColumn("s", F.lit(1)).unionByName(b.select(*cols).withColumn("s", F.lit(-1)))
    return x.groupBy(*cols).agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") > 0).alias("only_a"), F.count_if(F.col("s") < 0).alias("only_b"))
