"""Scans and sinks: multi-part tables with a lenient contract, subset reads, drift and delivery reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import canonical_ids

#: Readers by file ending; text formats come with a header and may begin with a byte order mark.
READERS = {"csv": ",", "tsv": "\t", "txt": "\t"}


def read_file(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """CSV, TSV, TXT or Parquet by its ending; text columns stay strings."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    df = spark.read.options(**({"header": True, "sep": READERS[kind], "encoding": "UTF-8"} | options)).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


@dataclass
class Part:
    """One part of a logical table: its rows, the tag they get, and what differs from the contract."""

    rows: DataFrame
    tag: str
    rename: dict[str, str] = field(default_factory=dict)
    offsets: dict[str, float] = field(default_factory=dict)


def load_table(parts: list[Part], types: dict[str, str] | None = None, dates: list[str] = (), columns: list[str] | None = None, cut: tuple[str, str] | None = None, tag: str = "cohort") -> DataFrame:
    """Union of parts by name: renamed, leniently cast, offset, dates parsed, cut at the common extraction time (column, time).

    With columns, only those are kept; the cut column is used first and dropped afterwards. Filters and columns reach the scans.
    """
    out = None
    for p in parts:
        x = p.rows.withColumnsRenamed(p.rename)
        x = x.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items() if c in x.columns} | {c: parse_dates(F.col(c)) for c in dates if c in x.columns})
        x = x.withColumns({c: F.col(c) + F.lit(o) for c, o in p.offsets.items()})
        if cut and cut[0] in x.columns:
            x = truncate(x, *cut)
        if columns is not None:
            x = x.select(*[c for c in columns if c in x.columns])
        x = x.withColumn(tag, F.lit(p.tag))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def parse_dates(x: F.Column) -> F.Column:
    """ISO timestamps with or without fractions or zone; what can't be read is null."""
    return F.coalesce(F.try_to_timestamp(x.cast("string")), F.try_to_timestamp(x.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss")))


def truncate(rows: DataFrame, column: str, at: str) -> DataFrame:
    """Rows not after the extraction time; rows without a time stay."""
    return rows.filter(F.col(column).isNull() | (F.col(column) <= F.lit(at).cast("timestamp")))


def describe(rows: DataFrame, expected: list[str]) -> DataFrame:
    """column, n_rows, null_share and status (ok, missing, extra) against the expected columns: one pass."""
    one = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in rows.columns))
    have = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(c).alias("null_share"), F.lit("ok" if c in expected else "extra").alias("status")) for c in rows.columns]
    gone = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.lit(None).cast("double").alias("null_share"), F.lit("missing").alias("status")) for c in expected if c not in rows.columns]
    return one.select(F.explode(F.array(*have, *gone)).alias("r")).select("r.*")


def read_for_vehicles(rows: DataFrame, aliases: DataFrame, wanted: DataFrame, key: str = "vehicle_id", ignore: tuple[str, ...] = ("cohort",)) -> DataFrame:
    """Canonical ids, then the wanted vehicles only, then exact duplicates dropped. aliases: (alias, vehicle_id), a small dimension."""
    x = canonical_ids(rows, aliases, key).join(wanted.select(key).distinct(), key, "left_semi")
    return x.drop(*[c for c in ignore if c in x.columns]).dropDuplicates()


def delivery_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: rows of both, whether contents are equal in any order, columns that are new or missing."""
    both = sorted(set(old.columns) & set(new.columns))

    def mark(x, p):
        return x.agg(F.count("*").alias(f"rows_{p}"), F.bit_xor(F.xxhash64(*both)).alias(f"xor_{p}"), F.sum((F.xxhash64(*both) % 1_000_003).cast("bigint")).alias(f"sum_{p}"))

    x = mark(old, "old").crossJoin(mark(new, "new"))  # one row each
    return x.select("rows_old", "rows_new", ((F.col("rows_old") == F.col("rows_new")) & F.col("xor_old").eqNullSafe(F.col("xor_new")) & F.col("sum_old").eqNullSafe(F.col("sum_new"))).alias("equal"),
                    F.lit(",".join(c for c in new.columns if c not in old.columns)).alias("new_columns"), F.lit(",".join(c for c in old.columns if c not in new.columns)).alias("missing_columns"))


def write_panel(panel: DataFrame, path: str, meta: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Parquet panel (dealt by vehicle if buckets is given) and a one-row JSON of metadata beside it; returns the panel as read again."""
    x = panel.repartition(buckets, "vehicle_id") if buckets else panel
    x.write.mode("overwrite").parquet(f"{path}/panel")
    one = panel.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in meta.items()), F.lit(",".join(panel.columns)).alias("columns"))
    one.write.mode("overwrite").json(f"{path}/meta")
    return panel.sparkSession.read.schema(panel.schema).parquet(f"{path}/panel")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


class Materialised:
    """Derived tables kept for reuse: built once below a folder, read from there afterwards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get(self, name: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
        where = f"{self.path}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            build().write.mode("overwrite").partitionBy(*partition_by).parquet(where)
        return self.spark.read.parquet(where)
