"""Tables written once, dealt by a key into buckets, so that windows, joins and as-of joins by that key need no shuffle of their rows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_MANIFEST.json"


class KeyedStore:
    """Derived tables below a shared folder, each a bucketed and sorted Parquet table with a manifest of the inputs it was made from.

    A table's version is the digest of its inputs' files (paths, lengths, times of change), its layout and the caller's version text,
    so it is built anew when any of these changes. A copy counts from the moment its manifest can be read whole: what a lost writer leaves is ignored, and of
    copies that several writers made of one version the first by name is read by all.

    Rows of one key are in one bucket, as any window by key needs them in one task. All tables of a store have the same number of
    buckets; ``deal`` brings other rows, such as points of an as-of join, to them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def get(self, name: str, build, key: str, order: list[str], inputs: list[str], version: str = "1") -> DataFrame:
        """The table of that name, with the key as its first column; build() gives its rows if there is no copy for the present inputs."""
        made_of = {"inputs": {p: self._digest(p) for p in sorted(inputs)}, "key": key, "order": order, "buckets": self.buckets, "version": version}
        base = f"{self.path}/{name}/{hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()[:32]}"
        found = self._copies(base)
        if not found:
            self._write(build(), f"{base}/{uuid.uuid4().hex}", made_of)
            found = self._copies(base)
        where, manifest = found[0]
        return self._table(name, where, manifest)

    def deal(self, rows: DataFrame, key: str) -> DataFrame:
        """rows in the buckets of the store, with the key first: joins and unions with its tables then shuffle nothing else."""
        return rows.select(key, *[c for c in rows.columns if c != key]).repartition(self.buckets, key)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Delete all versions of a table but the keep that were written last; returns how many went. Nobody may be reading those."""
        fs, p = self._fs(f"{self.path}/{name}")
        old = sorted(fs.listStatus(p), key=lambda s: -s.getModificationTime())[keep:] if fs.exists(p) else []
        for s in old:
            fs.delete(s.getPath(), True)
        return len(old)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _digest(self, path: str) -> str:
        """Number, bytes and a hash of names, lengths and times of an input's files: one aggregation of the listing, no content is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        n, size, mark = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
        return f"{n}-{size}-{mark}"

    def _copies(self, base: str) -> list[tuple[str, dict]]:
        """(folder, manifest) of the complete copies of a version, in order of their names."""
        fs, p = self._fs(base)
        out = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            where = f"{base}/{s.getPath().getName()}"
            _, m = self._fs(f"{where}/{MANIFEST}")
            if fs.exists(m):
                stream = fs.open(m)
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                try:
                    out.append((where, json.loads(text)))
                except ValueError:  # its writer was lost, or is writing yet
                    continue
        return sorted(out, key=lambda x: x[0])

    def _write(self, rows: DataFrame, where: str, made_of: dict) -> None:
        key, order = made_of["key"], made_of["order"]
        x = self.deal(rows, key).sortWithinPartitions(key, *order)
        table = f"fleetspan_{uuid.uuid4().hex}"
        x.write.format("parquet").bucketBy(self.buckets, key).sortBy(key, *order).option("path", where).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        fs, m = self._fs(f"{where}/{MANIFEST}")
        out = fs.create(m, False)
        out.write(json.dumps(made_of | {"schema": json.loads(x.schema.json())}).encode())
        out.close()

    def _table(self, name: str, where: str, manifest: dict) -> DataFrame:
        """The files as a bucketed table of this session's catalogue."""
        table = f"fleetspan_{name}_{where.rsplit('/', 1)[-1]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(manifest["schema"]).fields)
        order = ", ".join(f"`{c}`" for c in [manifest["key"], *manifest["order"]])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{manifest['key']}`) SORTED BY ({order}) INTO {manifest['buckets']} BUCKETS LOCATION '{where}'")
        x = self.spark.table(table)
        return x.select(*(F.col(c).alias(c) for c in x.columns))  # unions keep a partitioning only if its columns have no table's name before them
