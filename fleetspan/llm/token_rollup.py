"""Token counts as delta-maintained rollups.

A store below one folder keeps a log of commits. An entry names the folder of its batch, which holds a ledger of the documents that the batch
changed and the signed changes of the totals by source, language and tokenizer version. A batch of changes inserts, revises or deletes documents;
what a document added before is looked up in the ledger, and the difference goes to the totals. Ledgers lie in buckets by document; a look-up
reads the buckets of changed documents and shuffles only rows that may be theirs. Every COMPACT commits, ledgers and deltas are put
together in one folder, from which look-ups and totals then start. Totals are the sum of all deltas.

Commits count in the order of the log, whatever the batches' numbers. An entry is a file that only one writer can create; it is the last step of
a commit. A writer that comes second starts again on what the first has left, or finds its batch done. A batch that is in the log is left
alone, so a repeated commit changes nothing. An entry without content, of a writer that died while creating it, counts for nothing. (Where
creating a file is not exclusive, as in some object stores, a store may have one writer at a time.)

Tokenizers are functions from a string array to counts, by version name. ``bpe_counter`` reads a public vocabulary from a file
whose path is a parameter.

Defined results: null text has 0 tokens, and is a document all the same. A null source or language is a group of its own. Changes without a
doc_id are left out. If a batch has several changes of one doc_id, the last in the order (op, text) counts: deletes before inserts before
revisions. A delete of an unknown document and an empty batch change nothing; an insert of a known one revises it. Other columns are not read.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import hadoop, parted, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the vocabulary above.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LEDGER = "doc_id long, source string, lang string, version string, tokens long, live boolean"
DELTA = "source string, lang string, version string, docs long, tokens long"
BUCKETS = 64
COMPACT = 16


def word_counter():
    """Words as the other operators of this subpackage take them."""
    return tk.word_counts


def bpe_counter(path: str = VOCABULARY, pattern: str = PATTERN):
    """Tokens of a byte-level BPE vocabulary in ranks format, whole texts; special tokens are ordinary text."""

    def count(col: pa.Array) -> np.ndarray:
        kept = tk._kept()  # a worker reads the vocabulary once
        key = f"bpe {path} {pattern}"
        if key not in kept:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            kept[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = kept[key].encode_ordinary
        return np.fromiter((len(encode(t.as_py())) if t.is_valid else 0 for t in col), dtype=np.int64, count=len(col))

    return count


def counted(changes: DataFrame, counters: dict) -> DataFrame:
    """Changes (op, doc_id, text, source, lang) -> op, doc_id, source, lang and a column of counts for each tokenizer version."""
    versions = list(counters)
    ddl = "op string, doc_id long, source string, lang string, h long, " + ", ".join(f"`{v}` long" for v in versions)
    makers = dict(counters)

    def run(batches):
        made = {v: f() for v, f in makers.items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(made[v](batch.column(5)), pa.int64()) for v in versions)], ["op", "doc_id", "source", "lang", "h", *versions])

    text = F.when(F.col("op") == "delete", F.lit(None).cast("string")).otherwise(F.col("text"))
    return changes.filter("doc_id is not null").select("op", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.xxhash64("text").alias("h"), text.alias("text")).mapInArrow(run, ddl)


class RollupStore:
    """Rollups below path, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, counters: dict, compact: int = COMPACT):
        self.spark, self.path, self.counters, self.compact_every = spark, path.rstrip("/"), counters, compact

    def log(self) -> list[dict]:
        """Entries in order: seq, batch (None: the commits so far put together) and folder."""
        fs, p = hadoop(self.spark, f"{self.path}/log")
        out = []
        for at in sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []:
            for patience in range(50):  # of a writer that is at it
                stream = fs.open(hadoop(self.spark, f"{self.path}/log/{at}")[1])
                line = stream.readLine()
                stream.close()
                if line:
                    break
                time.sleep(0.1)
            out.append({"seq": int(at), **(json.loads(line) if line else {"batch": None, "folder": None})})
        return out

    def batches(self) -> list[int]:
        """Committed batches, in the order of their commits."""
        return [e["batch"] for e in self.log() if e["batch"] is not None]

    def _enter(self, seq: int, batch: int | None, folder: str) -> bool:
        """Write the entry seq, unless another writer has."""
        fs, p = hadoop(self.spark, f"{self.path}/log/{seq:012d}")
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)
        except Exception:  # noqa: BLE001 - file systems differ in what they raise
            if fs.exists(p):
                return False
            raise
        stream.write(bytearray(json.dumps({"batch": batch, "folder": folder}).encode() + b"\n"))
        stream.close()
        return True

    def _folders(self, log: list[dict]) -> list[str]:
        """Folders that count: the last that puts commits together, and those after it."""
        live = [e for e in log if e["folder"]]
        start = max((i for i, e in enumerate(live) if e["batch"] is None), default=0)
        return [e["folder"] for e in live[start:]]

    def _ledger(self, log: list[dict], changed: DataFrame | None = None) -> DataFrame:
        """The current row of each document and version, of those that may be in changed (a stored table with doc_id) if it is given."""
        folders = self._folders(log)
        if not folders:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER + ", seq long, bucket int").option("basePath", f"{self.path}/ledger").parquet(*(f"{self.path}/ledger/folder={f}" for f in folders)).drop("folder")
        if changed is not None:
            buckets = [r[0] for r in changed.select(self._bucket()).distinct().collect()]  # BUCKETS at most
            rows = parted(rows.filter(F.col("bucket").isin(buckets)), "doc_id", changed)[0]
        last = F.max_by(F.struct("source", "lang", "tokens", "live"), "seq").alias("r")
        return rows.groupBy("doc_id", "version").agg(last).select("doc_id", "r.source", "r.lang", "version", "r.tokens", "r.live")

    def ledger(self) -> DataFrame:
        """The current rows of all documents ever seen, by version: the last commit that names a document counts."""
        return self._ledger(self.log())

    @staticmethod
    def _bucket():
        return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _write(self, folder: str, seq: int, ledger: DataFrame, delta: DataFrame) -> None:
        rows = ledger.select("*", F.lit(seq).cast("long").alias("seq"), self._bucket())
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.path}/ledger/folder={folder}")
        delta.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/delta/{folder}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (op: insert, revise or delete; doc_id, text, source, lang) as the given batch; False if it is committed already."""
        if batch in self.batches():
            return False
        order = F.when(F.col("op") == "delete", 0).when(F.col("op") == "insert", 1).otherwise(2)
        by = Window.partitionBy("doc_id").orderBy(order.desc(), F.desc("h"))
        one = counted(changes, self.counters).withColumn("k", F.row_number().over(by)).filter("k = 1")
        values = ", ".join(f"'{v}', `{v}`" for v in self.counters)
        new = stored(one.select("doc_id", "source", "lang", F.expr(f"stack({len(self.counters)}, {values}) as (version, tokens)"), (F.col("op") != "delete").alias("live")), "changes")
        while True:
            log = self.log()
            if batch in [e["batch"] for e in log]:
                return False
            seq, folder = len(log), uuid.uuid4().hex
            old = self._ledger(log, new).filter("live").select("doc_id", "version", F.col("source").alias("s0"), F.col("lang").alias("l0"), F.col("tokens").alias("t0"), F.lit(True).alias("had"))
            met = new.join(old.hint("merge"), ["doc_id", "version"], "left").filter("live or had")
            # what is deleted keeps its old group in the ledger
            kept = met.select("doc_id", F.when(F.col("live"), F.col("source")).otherwise(F.col("s0")).alias("source"), F.when(F.col("live"), F.col("lang")).otherwise(F.col("l0")).alias("lang"), "version", F.when(F.col("live"), F.col("tokens")).otherwise(0).alias("tokens"), "live")
            signed = met.select(F.explode(F.filter(F.array(
                F.when(F.col("live"), F.struct("source", "lang", "version", F.lit(1).cast("long").alias("docs"), F.col("tokens").alias("tokens"))),
                F.when(F.col("had"), F.struct(F.col("s0").alias("source"), F.col("l0").alias("lang"), "version", F.lit(-1).cast("long").alias("docs"), (-F.col("t0")).alias("tokens")))), lambda x: x.isNotNull())).alias("d")).select("d.*")
            self._write(folder, seq, kept, signed)
            if self._enter(seq, batch, folder):
                if len(self._folders(self.log())) > self.compact_every:
                    self.compact()
                return True

    def compact(self) -> bool:
        """Put all commits so far together in one folder; False if another writer was first. Older folders are left for readers that are at them."""
        log = self.log()
        if len(self._folders(log)) < 2:
            return False
        folder = uuid.uuid4().hex
        self._write(folder, log[-1]["seq"], self._ledger(log), self._deltas(log))
        return self._enter(len(log), None, folder)

    def _deltas(self, log: list[dict]) -> DataFrame:
        paths = [f"{self.path}/delta/{f}" for f in self._folders(log)]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is there; groups that came to nothing are gone."""
        rows = self._deltas(self.log())
        return rows.groupBy("source", "lang", "version").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def rebuild(docs: DataFrame, counters: dict) -> DataFrame:
    """The same totals counted at once, for checks."""
    values = ", ".join(f"'{v}', `{v}`" for v in counters)
    x = counted(docs.withColumn("op", F.lit("insert")), counters).select("source", "lang", F.expr(f"stack({len(counters)}, {values}) as (version, tokens)"))
    return x.groupBy("source", "lang", "version").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
