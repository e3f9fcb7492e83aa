"""Canonical identifiers, duplicate accounting and set operations between deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_ids(rows: DataFrame, aliases: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """rows with the key replaced by its canonical id where aliases (alias, vehicle_id) name one. Spark broadcasts aliases if they are small."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("vehicle_id").alias("_canon"))
    return rows.join(a, F.col(key) == F.col("_alias"), "left").withColumn(key, F.coalesce("_canon", key)).drop("_alias", "_canon")


def collapse_clones(rows: DataFrame, aliases: DataFrame, key: str = "vehicle_id", cohort: str = "cohort") -> DataFrame:
    """Canonical ids; rows that are equal but for cohort collapse, and cohort is failed if any of the vehicle's is."""
    x = canonical_ids(rows, aliases, key)
    any_failed = F.max((F.col(cohort) == "failed").cast("int")).over(Window.partitionBy(key))
    x = x.withColumn(cohort, F.when(any_failed == 1, "failed").otherwise("healthy"))
    return x.dropDuplicates()


def one_row_per_vehicle(rows: DataFrame, key: str = "vehicle_id", event: str = "event_day") -> DataFrame:
    """The earliest event of each vehicle, nulls last, and how many distinct events were recorded."""
    others = [c for c in rows.columns if c not in (key, event)]
    by = Window.partitionBy(key).orderBy(F.col(event).asc_nulls_last(), *others)
    n = F.size(F.collect_set(event).over(Window.partitionBy(key)))
    return rows.withColumn("n_events_recorded", n).withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def duplicate_report(rows: DataFrame, aliases: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """One row: n_rows, duplicates as they are, duplicates under canonical ids, those due to clones, and other ones."""
    cols = sorted(rows.columns)

    def extra(x):
        return x.groupBy(*cols).count().agg(F.sum("count").cast("bigint").alias("n"), F.sum(F.col("count") - 1).cast("bigint").alias("d"))

    raw, canon = extra(rows).toDF("n_rows", "dup_raw"), extra(canonical_ids(rows, aliases, key)).toDF("_n", "dup_canonical")
    return raw.crossJoin(canon).select("n_rows", "dup_raw", "dup_canonical", (F.col("dup_canonical") - F.col("dup_raw")).alias("dup_clones"))  # one row each


def history_clones(rows: DataFrame, cols: list[str], key: str = "vehicle_id") -> DataFrame:
    """Vehicles with the same history: fingerprint over all rows, then groups of more than one vehicle."""
    prints = rows.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("f1"), F.sum(F.xxhash64(*cols, F.lit(1)) % 1_000_000_007).alias("f2"))
    pairs = prints.groupBy("n", "f1", "f2").agg(F.min(key).alias("first"), F.count("*").alias("n_vehicles"), F.max(key).alias("last")).filter("n_vehicles > 1")
    return pairs.select("first", "last", "n_vehicles", F.col("n").alias("n_rows"))


def shared_rows(rows: DataFrame, keys: list[str], key: str = "vehicle_id", least: float = 0.5) -> DataFrame:
    """Pairs of vehicles by the share of rows (equal in keys) of the smaller history that both hold, from least (above 0) on.

    An overlap join by rare-first prefixes: a vehicle whose n distinct rows share at least m = ceil(least * n) with another's misses at most n - m of
    them there, so one of its n - m + 1 rarest is among them. Only these look for holders, among vehicles with as many rows or more; rows that one vehicle alone
    holds, the rarest of all, find none. Candidates are then counted row by row. A popular row is looked up only by vehicles that hold too few rarer ones.
    """
    x = rows.select(key, *keys).distinct()
    x = x.withColumn("_df", F.count("*").over(Window.partitionBy(*keys)))
    n, shared = F.count("*").over(Window.partitionBy(key)), F.count_if(F.col("_df") > 1).over(Window.partitionBy(key))
    need = F.ceil(F.col("_n") * F.lit(least) - 1e-9)
    x = x.withColumns({"_n": n, "_shared": shared, "_k": F.row_number().over(Window.partitionBy(key).orderBy("_df", *keys))})
    x = x.filter((F.col("_df") > 1) & (F.col("_shared") > 0))
    probe = x.filter((F.col("_shared") >= need) & (F.col("_k") <= F.col("_n") - need + 1)).select(*keys, F.col(key).alias("_a"), F.col("_n").alias("_na"))
    held = x.select(*keys, F.col(key).alias("_b"), F.col("_n").alias("_nb"))
    larger = (F.col("_nb") > F.col("_na")) | ((F.col("_nb") == F.col("_na")) & (F.col("_b") > F.col("_a")))
    pairs = probe.join(held, keys).filter(larger).select("_a", "_b", "_na").distinct()
    a, b = x.select(F.col(key).alias("_a"), *keys), x.select(F.col(key).alias("_b"), *keys)
    p = pairs.join(a, "_a").join(b, ["_b", *keys]).groupBy("_a", "_b", "_na").agg(F.count("*").alias("n_shared"))
    p = p.withColumn("share", F.col("n_shared") / F.col("_na").cast("double")).filter(F.col("share") >= least)
    return p.select(F.least("_a", "_b").alias("veh_a"), F.greatest("_a", "_b").alias("veh_b"), "n_shared", "share")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys in both, only in a, only in b."""
    x = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full_outer")
    return x.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def transitions(old: DataFrame, new: DataFrame, key: str, side: str) -> DataFrame:
    """Counts of keys by (old side, new side); absent where one lacks the key."""
    x = old.select(key, F.col(side).alias("before")).join(new.select(key, F.col(side).alias("after")), key, "full_outer")
    return x.groupBy(F.coalesce("before", F.lit("absent")).alias("before"), F.coalesce("after", F.lit("absent")).alias("after")).agg(F.count("*").alias("n"))
