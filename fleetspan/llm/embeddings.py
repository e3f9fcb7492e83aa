"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosines, connected components.

Only vectors with the same label (not null) and the same length are compared. Exact copies are one node with a multiplicity. Every node
falls into one bucket in each of several tables; the number of hyperplanes follows the largest label, the number of tables follows the
wanted recall at the threshold. Buckets larger than BLOCK nodes are compared block against block, and a pair that meets in several
tables counts in the first. A task returns sums of links by node and a spanning forest of what it linked, never the pairs. Vectors are scaled by
powers of two, which leaves cosines as they are, so that no norm overflows or vanishes; they travel as floats where these hold them exactly.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing and
are kept. Rows equal in vec_id, label and vector are one vector. A null vec_id is kept, never names a component and has links counted.
Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, met, stored
from .components import components

BLOCK = 1024
#: Nodes of small buckets that one group handles.
CELL = 8192


def plan_tables(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hyperplanes a table, tables): some 64 nodes a bucket, and a miss probability of 1 - recall at most for a pair at the threshold."""
    bits = min(24, max(4, math.ceil(math.log2(max(2, largest) / 64))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def hashed(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds dim, vec (bytes) and codes (one a table) to rep, mult, label, embedding."""

    def run(batches):
        planes = {}
        for batch in batches:
            vecs = [np.array(v.as_py(), dtype=np.float64) for v in batch.column("embedding")]
            vecs = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in vecs]
            codes = np.zeros((len(vecs), tables), dtype=np.int32)
            dims = np.array([len(v) for v in vecs], dtype=np.int32)
            for d in np.unique(dims):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
                at = np.flatnonzero(dims == d)
                side = (np.stack([vecs[i] for i in at]) @ planes[d] > 0).reshape(len(at), tables, bits)
                codes[at] = side @ (1 << np.arange(bits, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("mult"), batch.column("label"), pa.array(dims), pa.array([_packed(v) for v in vecs], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * tables), pa.array(codes.reshape(-1)))],
                ["rep", "mult", "label", "dim", "vec", "codes"])

    return nodes.select("rep", "mult", "label", "embedding").mapInArrow(run, "rep long, mult long, label long, dim int, vec binary, codes array<int>")


def _packed(v: np.ndarray) -> bytes:
    narrow = v.astype(np.float32)
    return (narrow if (narrow == v).all() else v).tobytes()


def _unpacked(raw, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64)


def _compare(threshold: float):
    def run(table):
        """Links of the rows of table: within each bucket, or between its two blocks."""
        table = table.sort_by([("label", "ascending"), ("dim", "ascending"), ("t", "ascending"), ("code", "ascending"), ("i", "ascending"), ("j", "ascending")])
        rep, mult, block = (table.column(c).to_numpy() for c in ("rep", "mult", "block"))
        keys = np.stack([table.column(c).to_numpy() for c in ("label", "dim", "t", "code", "i", "j")], axis=1)
        codes = table.column("codes").combine_chunks()
        tables = len(codes[0])
        codes = codes.flatten().to_numpy().reshape(-1, tables)
        vec = table.column("vec")
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        out_rep, out_add, out_root = [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(rep))):
            if hi - lo < 2:
                continue
            _, dim, t, _, i, j = keys[lo]
            x = np.stack([_unpacked(vec[r].as_buffer(), dim) for r in range(lo, hi)])
            norm = np.sqrt((x * x).sum(axis=1))
            r, m, c = rep[lo:hi], mult[lo:hi], codes[lo:hi, :t]
            left = np.flatnonzero(block[lo:hi] == i)
            right = left if i == j else np.flatnonzero(block[lo:hi] == j)
            if not len(left) or not len(right) or t and ((c == c[0]).all(axis=0)).any():
                continue  # all met in an earlier table
            link = (x[left] @ x[right].T) / np.outer(norm[left], norm[right]) >= threshold
            if not link.any():
                continue
            a, b = np.nonzero(link)
            new = left[a] < right[b] if i == j else np.ones(len(a), dtype=bool)
            a, b = left[a[new]], right[b[new]]
            new = np.ones(len(a), dtype=bool)
            for k in range(t):
                new &= c[a, k] != c[b, k]
            a, b = a[new], b[new]
            if not len(a):
                continue
            add = np.bincount(a, m[b], minlength=hi - lo) + np.bincount(b, m[a], minlength=hi - lo)
            root = np.arange(hi - lo)
            while True:  # each takes the smallest root among its own and its neighbours', until none changes
                new_root = root.copy()
                np.minimum.at(new_root, a, root[b])
                np.minimum.at(new_root, b, root[a])
                new_root = new_root[new_root]
                if (new_root == root).all():
                    break
                root = new_root
            hit = np.flatnonzero(add)
            out_rep.append(r[hit])
            out_add.append(add[hit].astype(np.int64))
            out_root.append(r[root[hit]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"rep": cat(out_rep), "add": cat(out_add), "root": cat(out_root)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stored(rows.select("vec_id", "label", "embedding", (sound & F.col("label").isNotNull()).alias("sound")).withColumn("key", F.when(F.col("sound"), F.sha2(F.to_json(F.struct("label", "embedding")), 256))), "vectors")
    # a node is numbered by its smallest vec_id, or, without one, by a negative number
    nodes = rows.filter("sound").groupBy("key").agg(F.coalesce(F.min("vec_id"), -F.abs(F.xxhash64("key")) - 1).alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes, "nodes")
    largest = nodes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = plan_tables(largest, threshold, recall)
    marked = stored(hashed(nodes, bits, tables, seed), "codes")
    spread = marked.select("*", F.posexplode("codes").alias("t", "code"))
    sizes = spread.groupBy("label", "dim", "t", "code").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "buckets")
    spread = met(spread, sizes, ["label", "dim", "t", "code"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = max(1, math.ceil(nodes.count() * tables / CELL))
    spread = spread.select("rep", "mult", "label", "dim", "t", "code", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "codes", "vec",
                           F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", "dim", "t", "code"), F.lit(cells))).otherwise(F.xxhash64("label", "dim", "t", "code", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"), "blocks")
    found = stored(spread.groupBy("cell", F.col("blocks") == 1).applyInArrow(_compare(threshold), "rep long, add long, root long"), "links")
    discard(marked, sizes)
    degree = found.groupBy("rep").agg(F.sum("add").alias("near"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = nodes.select("key", "rep", "mult").join(degree.hint("merge"), "rep", "left").join(groups.hint("merge"), F.col("rep") == F.col("id"), "left").select(
        "key", (F.coalesce("near", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), F.col("mult").alias("size"))
    known = met(rows.filter("sound").select("vec_id", "key"), stored(facts, "facts"), ["key"]).select("vec_id", "n", "c")
    out = known.union(rows.filter("not sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    out = out.select("vec_id", F.col("n").alias("n_links"), F.when(F.col("c") >= 0, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
