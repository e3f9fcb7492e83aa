"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed into keep bitmaps.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case. Keys of at least min_chars code points that at
least min_docs documents hold lose all their lines except in the largest doc_id that holds them.

1. Each such line becomes a 128-bit hash with its document and position; text goes no further.
2. The hashes are range-partitioned and sorted by hash, document (largest first) and position. Documents and positions belong to the order that
   is cut into ranges, so a key that a third of all lines share is spread over many ranges.
3. Each range is streamed. The first document of a key keeps its lines; those of the others go once min_docs documents are seen. At most
   the lines of min_docs - 1 documents are held. Only the first and the last key of a range may lie in other ranges too: their
   lines wait for the sums of a table with two rows a range.
4. Positions that go make one compressed bitmap a document. Texts are shuffled only where a document may have a bitmap.

Defined results: null and empty texts are one empty line, which is never dropped. Rows that share a doc_id count as one document and
keep or lose a key's lines alike; each row is returned on its own. Rows with a null doc_id count as no document and lose nothing. min_docs below
2 counts as 2. Empty tables give an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, flagged, met, stored

SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Kinds of rows that a range yields: a line that goes, a line of an edge key, the sums of an edge key.
GONE, OPEN, EDGE = 0, 1, 2
SCHEMA = "kind int, part int, h1 long, h2 long, doc_id long, version long, copies long, pos int, n long, hi long, lo long"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (not null) and version, which tells rows of one doc_id with different texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """h1, h2 (128 bits of the key's hash), doc_id, version and pos of each line whose key has at least min_chars code points.
    Repeats of a row that meet in a batch give their lines once, with the number of copies."""

    def run(batches):
        for batch in batches:
            digests, rows, pos = [], [], []
            names = list(zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()))
            copies, done = Counter(names), set()
            for r, text in enumerate(batch.column("text").to_pylist()):
                if names[r] in done:
                    continue
                done.add(names[r])
                for i, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
                        digests.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
                        rows.append(r)
                        pos.append(i)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(at), batch.column("version").take(at), pa.array([copies[names[r]] for r in rows], pa.int64()), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "version", "copies", "pos"])

    return _texts(docs).filter("doc_id is not null").mapInArrow(run, "h1 long, h2 long, doc_id long, version long, copies long, pos int")


class _Group:
    """The key that a stream is in: documents so far, the largest and the smallest of them, and lines held back."""

    def __init__(self, rows, first: bool):
        self.key, self.hi, self.lo, self.n = (rows[0][0], rows[1][0]), rows[2][0], rows[2][0], 1
        self.first, self.sure, self.held = first, False, []

    def add(self, rows, min_docs: int):
        """(kind, lines to yield) after more lines of the key."""
        doc = rows[2]
        self.n += int((doc[1:] != doc[:-1]).sum()) + int(doc[0] != self.lo)
        self.lo = doc[-1]
        if self.first:
            return OPEN, rows
        self.held.append(rows)
        if not self.sure and self.n < min_docs:
            return GONE, rows[:, :0]
        self.sure, rows, self.held = True, np.concatenate(self.held, axis=1), []
        return GONE, rows[:, rows[2] != self.hi]


def _decide(min_docs: int):
    """Stream of one range, sorted by key, document (largest first) and position: yields rows of SCHEMA."""

    def lines(kind, part, rows):
        k = rows.shape[1]
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, part, np.int32)), *(pa.array(x) for x in rows[:5]), pa.array(rows[5].astype(np.int32)), none, none, none], [c.split()[0] for c in SCHEMA.split(", ")])

    def edge(part, g):
        one = [EDGE, part, *g.key, None, None, None, None, g.n, g.hi, g.lo]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x)], t) for x, t in zip(one, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches):
        g, part = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "doc_id", "version", "copies", "pos")])
            heads = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
            ends = np.append(heads[1:], rows.shape[1])
            at = 0  # the run that comes next
            if g is None or g.key == (rows[0][0], rows[1][0]):
                g = g or _Group(rows, first=True)
                yield lines(GONE if not g.first else OPEN, part, g.add(rows[:, : ends[0]], min_docs)[1])
                at = 1
            if at == len(heads):
                continue
            if g.first:  # its key ends here
                yield edge(part, g)
            if at < len(heads) - 1:  # keys that begin and end in this batch
                a, b = heads[at], heads[-1]
                inner, starts = rows[:, a:b], heads[at:-1] - a
                new = np.append(True, inner[2, 1:] != inner[2, :-1])
                new[starts] = True
                sizes = np.diff(np.append(starts, b - a))
                gone = np.repeat(np.add.reduceat(new.astype(np.int64), starts) >= min_docs, sizes) & (inner[2] != np.repeat(inner[2, starts], sizes))
                yield lines(GONE, part, inner[:, gone])
            rest = rows[:, heads[-1] :]
            g = _Group(rest, first=False)
            yield lines(GONE, part, g.add(rest, min_docs)[1])
        if g is not None:
            for rows in g.held:
                yield lines(OPEN, part, rows)
            yield edge(part, g)

    return run


def bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, version, n_dropped, keep (bit i of the decompressed bytes, most significant first: line i stays; lines past its end stay) of the documents
    that lose lines, and size, the rows of docs that are this document. A stored table."""
    spark, min_docs = docs.sparkSession, max(2, min_docs)
    hashes = stored(line_hashes(docs, min_chars), "lines")
    order = [*KEY, F.desc("doc_id"), "version", "pos"]
    ranged = hashes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    told = stored(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_decide(min_docs), SCHEMA), "ranges")
    discard(hashes)
    # a document at the end of one range and the start of the next counts once
    by = Window.partitionBy(*KEY).orderBy("part")  # two rows a range at most
    twice = F.when(F.lag("lo").over(by) == F.col("hi"), 1).otherwise(0)
    edges = told.filter(F.col("kind") == EDGE).select(*KEY, "part", "n", "hi", "lo").withColumn("twice", twice)
    edges = edges.groupBy(*KEY).agg(F.sum(F.col("n") - F.col("twice")).alias("n"), F.max("hi").alias("hi")).filter(F.col("n") >= min_docs)
    line = ["doc_id", "version", "copies", "pos"]
    late = told.filter(F.col("kind") == OPEN).select(*KEY, *line).join(F.broadcast(edges), KEY).filter(F.col("doc_id") != F.col("hi"))
    gone = told.filter(F.col("kind") == GONE).select(*line).union(late.select(*line))
    # a document's repeats lose the same lines, so its set of positions is bounded by its text
    gone = gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("pos"), F.sum("copies").alias("rows"))

    def run(batches):
        for batch in batches:
            keep, n = [], []
            for x in batch.column("pos"):
                at = x.values.to_numpy()
                bits = np.ones((int(at.max()) // 8 + 1) * 8, dtype=np.uint8)
                bits[at] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                n.append(len(at))
            size = [r // k for r, k in zip(batch.column("rows").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(keep, pa.binary()), pa.array(size, pa.int64())], ["doc_id", "version", "n_dropped", "keep", "size"])

    out = stored(gone.mapInArrow(run, "doc_id long, version long, n_dropped long, keep binary, size long"), "bitmaps")
    discard(told)
    return out


def kept_lines(text: str, keep: bytes | None) -> str:
    """text without the lines that the bitmap drops."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))
    return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def _applied(docs: DataFrame, marks: DataFrame, text_too: bool) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256, or kept_text, of each row. The table is read once, or twice if one document is very many rows."""
    rows = flagged(_texts(docs), "doc_id", marks, "hit")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # what surely loses nothing is done with here; only the other texts are shuffled
    rows = rows.select("doc_id", "version", n_lines.cast("long").alias("n_lines"), F.when(F.col("hit") | F.lit(text_too), F.col("text")).alias("text"), F.when(~F.col("hit"), F.sha2("text", 256)).alias("sha"))
    joined = met(rows, marks, ["doc_id", "version"], "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "text", "sha", "keep")

    def run(batches):
        for batch in batches:
            out = []
            for text, sha, keep in zip(*(batch.column(c).to_pylist() for c in ("text", "sha", "keep"))):
                out.append(kept_lines(text, keep) if text_too else sha or hashlib.sha256(kept_lines(text, keep).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", name])

    name = "kept_text" if text_too else "kept_sha256"
    return joined.mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, {name} string")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text of each row."""
    return _applied(docs, bitmaps(docs, min_chars, min_docs), True)


def digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 (lower-case hex, of the kept lines in UTF-8) of each row."""
    return _applied(docs, bitmaps(docs, min_chars, min_docs), False)
