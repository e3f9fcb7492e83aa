"""Exact top-k inner products by pivot-table elimination.

Every vector is stored with its distances to PIVOTS fixed vectors. By the triangle inequality a candidate is at least
max over pivots of |d(query, pivot) - d(candidate, pivot)| from the query; as 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, that bounds its inner
product from above.

1. Vectors fall into cells by their nearest pivot, and cells into blocks of BLOCK candidates or QUERY_BLOCK queries.
2. Each query is searched in one block of its own cell. Its k-th best score there is a threshold that the result can't fall below.
3. A block's least and greatest distances to each pivot bound all its scores. Pairs of a query block and a candidate block whose bound is below
   the least threshold of the queries are left out; vectors travel to the pairs that stay.
4. In a pair, pivots come in two turns, the second for candidates that the first leaves above the threshold. What is left is evaluated in the
   order of the bounds until the k-th best score exceeds every bound left. The pairs' best are ranked together; ties go to the smaller vec_id.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part. Of rows that share a
vec_id the least vector (component by component) counts, so no vec_id is listed twice. Shorter vectors count as padded with zeros. Empty tables
give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

PIVOTS = 32
FIRST = 8
QUERY_BLOCK = 1024
BLOCK = 4096


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer()) for x in column]
    d = max((len(r) for r in rows), default=0)
    if all(len(r) == d for r in rows):
        return np.stack(rows) if rows else np.zeros((0, 0))
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def with_pivots(rows: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """vec_id, vec and dist (distances to the pivots; both as bytes of doubles), cell (the nearest pivot) and norm (the square)."""

    def run(batches):
        for batch in batches:
            vecs = [np.array(v.as_py(), dtype=np.float64) for v in batch.column(1)]
            dist = []
            for v in vecs:
                d = max([len(v), *map(len, pivots)])
                p = np.zeros((len(pivots), d))
                for i, x in enumerate(pivots):
                    p[i, : len(x)] = x
                p[:, : len(v)] -= v
                dist.append(np.sqrt((p * p).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in vecs], pa.binary()), pa.array([d.tobytes() for d in dist], pa.binary()), pa.array([int(d.argmin()) for d in dist], pa.int32()), pa.array([float(v @ v) for v in vecs], pa.float64())],
                ["vec_id", "vec", "dist", "cell", "norm"])

    return rows.mapInArrow(run, "vec_id long, vec binary, dist binary, cell int, norm double")


def best_in_block(qid, q, qd, cid, c, cd, k: int, known=None):
    """Yield (query id, candidate ids, scores) of each query's k best in the block; with known scores, only of those that reach them."""
    cn = (c * c).sum(axis=1)
    exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, c.shape[1]) < 2**53
    ci = None if exact else c.astype(np.int64)
    turns = [np.ascontiguousarray(cd[:, :FIRST]), np.ascontiguousarray(cd[:, FIRST:])]
    for i in range(len(qid)):
        floor = -np.inf if known is None else known[i]
        qn = float(q[i] @ q[i])
        live, lower = np.flatnonzero(cid != qid[i]), np.zeros(len(cid))
        for turn, at in zip(turns, (slice(0, FIRST), slice(FIRST, None))):
            if turn.shape[1] and len(live):
                some = turn if len(live) == len(cid) else turn[live]
                lower[live] = np.maximum(lower[live], np.abs(some - qd[i, at]).max(axis=1))
                room = (qn + cn[live]) * (1 + 2e-9) + 2e-6 - lower[live] ** 2  # with something for rounding
                live = live[room / 2 >= floor]
        bound = ((qn + cn[live]) * (1 + 2e-9) + 2e-6 - lower[live] ** 2) / 2
        order = np.argsort(-bound)
        live, bound = live[order], bound[order]
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(64, 8 * k)
        while at < len(live):
            if len(ids) == k and scores[-1] > bound[at]:
                break
            take = live[at : at + step]
            new = np.rint(c[take] @ q[i]).astype(np.int64) if exact else ci[take] @ q[i].astype(np.int64)
            ids, scores = np.concatenate([ids, cid[take]]), np.concatenate([scores, new])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            at += step
            step *= 2
        yield qid[i], ids, scores


def _ranges(rows: DataFrame, block: str, extra: dict) -> DataFrame:
    """block, lo and hi (arrays: least and greatest distance to each pivot in the block) and the aggregates of extra."""

    def part(batches):
        for batch in batches:
            dist = _matrix(batch.column(1))
            keys = batch.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, int)
            lo, hi = (f.reduceat(dist[order], heads, axis=0) if len(heads) else dist[:0] for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(keys[order][heads]), pa.array(lo.tolist(), pa.list_(pa.float64())), pa.array(hi.tolist(), pa.list_(pa.float64()))], [block, "lo", "hi"])

    parts = rows.select(block, "dist").mapInArrow(part, f"{block} long, lo array<double>, hi array<double>").select(block, F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "x"))
    ends = parts.groupBy(block, "p").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi")).groupBy(block).agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("x"))
    others = rows.groupBy(block).agg(*(f.alias(c) for c, f in extra.items()))
    return ends.select(block, F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")).join(others.hint("merge"), block)


def _search(k: int):
    def search(cand, query):
        out_q, out_c, out_s = [], [], []
        if cand.num_rows and query.num_rows:
            c, q = _matrix(cand.column("vec")), _matrix(query.column("vec"))
            d = max(c.shape[1], q.shape[1])
            cd, qd = _matrix(cand.column("dist")), _matrix(query.column("dist"))
            for i, ids, scores in best_in_block(query.column("vec_id").to_numpy(), _wide(q, d), qd, cand.column("vec_id").to_numpy(), _wide(c, d), cd, k, query.column("floor").to_numpy()):
                out_q.append(np.full(len(ids), i, dtype=np.int64))
                out_c.append(ids)
                out_s.append(scores)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_c), "score": cat(out_s)})

    return search


def top_inner(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a Column over vec_id that marks the queries."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null").filter(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = stored(rows, "vectors")
    chosen = [r["vec"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    table = stored(with_pivots(rows, chosen), "pivots")
    discard(rows)
    sizes = {r["cell"]: (r["n"], r["nq"]) for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq")).collect()}  # a row a pivot
    schema = "query_id long, vec_id long, score long"
    if not sum(nq for _, nq in sizes.values()):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def block(of, most):
        """Cell and, by hash, the block in it."""
        blocks = F.array(*(F.lit(max(1, math.ceil(sizes.get(c, (0, 0))[of] / most))) for c in range(len(chosen))))
        return (F.col("cell").cast("long") * (1 << 40) + F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("cell") + 1))).alias("b" if of == 0 else "q")

    cands = table.select("*", block(0, BLOCK))
    asked = table.filter(is_query).select("*", block(1, QUERY_BLOCK))
    # each query in one block of its cell
    own = table.filter(is_query).select("vec_id", "vec", "dist", F.lit(float("-inf")).alias("floor"), block(0, BLOCK))
    first = stored(cands.select("vec_id", "vec", "dist", "b").groupBy("b").cogroup(own.groupBy("b")).applyInArrow(_search(k), schema), "first")
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("least")).alias("floor"))
    asked = stored(asked.join(floors.hint("merge"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "asked")
    x = _ranges(cands, "b", {"cn": F.max("norm")})
    y = _ranges(asked, "q", {"qn": F.max("norm"), "floor": F.min("floor")}).select("q", F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), "qn", "floor")
    # the stated queries against all rows, in blocks: every query block meets every block once, as summaries
    tied = y.crossJoin(x)
    apart = F.array_max(F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("qlo", "qhi"), lambda c, o: F.greatest(F.lit(0.0), c["lo"] - o["qhi"], o["qlo"] - c["hi"])))
    pairs = stored(tied.filter(((F.col("qn") + F.col("cn")) * (1 + 2e-9) + 2e-6 - apart * apart) / 2 >= F.col("floor")).select("b", "q"), "pairs")
    cands = cands.select("vec_id", "vec", "dist", "b").join(pairs.hint("merge"), "b")
    asked = asked.select("vec_id", "vec", "dist", "floor", "q").join(pairs.hint("merge"), "q")
    found = cands.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(_search(k), schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
