"""Shared folders, stored tables, and joins that stay whole and balanced whatever the sizes of their sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys fall into 2^CELL_BITS cells of a bitmap, which is 2^(CELL_BITS - 6) longs at most whatever the number of keys.
CELL_BITS = 26
#: A key is hot if more than 1 / HOT of all rows have it. There are fewer than HOT such keys.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/fleetspan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def hadoop(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            remove(t.sparkSession, path)


def _cell(key: str) -> str:
    return f"xxhash64(`{key}`) & {(1 << CELL_BITS) - 1}"


def flagged(rows: DataFrame, key: str, keys: DataFrame, flag: str, own: str | None = None) -> DataFrame:
    """rows and a boolean column: False only if the row's key surely isn't in the column own of keys. See parted."""
    word, bits = fresh(rows, "_word"), fresh(rows, "_bits")
    cell = _cell(own or key)
    words = keys.select(F.expr(f"shiftright({cell}, 6)").alias(word), F.expr(f"shiftleft(1L, cast({cell} & 63 as int))").alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    words = F.broadcast(words)
    held = rows.withColumn(word, F.expr(f"shiftright({_cell(key)}, 6)")).join(words, word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(`{bits}`, cast({_cell(key)} & 63 as int)) & 1") == 1, F.lit(False))
    return held.select(*rows.columns, hit.alias(flag))


def parted(rows: DataFrame, key: str, keys: DataFrame, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the column own of keys, the other rows, whose key surely isn't there).

    The keys' bitmap of 2^CELL_BITS hashed cells is broadcast: 2^20 pairs of longs at most, however many keys there are. If they
    fill it, more rows go to the first part, and no result changes. Both parts have the columns of rows. keys should be a stored table.
    """
    flag = fresh(rows, "_hit")
    held = flagged(rows, key, keys, flag, own)
    return held.filter(flag).select(*rows.columns), held.filter(f"not `{flag}`").select(*rows.columns)


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, a stored table that is unique on keys and holds in the column size how many rows of left have them.

    Hot keys, fewer than HOT by their definition, are broadcast; the others are merged by a shuffle in which no key has more
    than 1 / HOT of the rows. left is read once more if there are hot keys. The columns of right come without size.
    """
    total, most = right.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    cold = right.filter(F.col("size") * HOT <= total).drop("size").hint("merge")
    if most * HOT <= total:
        return left.join(cold, keys, how)
    hot = right.filter(F.col("size") * HOT > total)
    hot = F.broadcast(hot.drop("size"))
    apart = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return left.join(hot, keys).unionByName(apart)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
