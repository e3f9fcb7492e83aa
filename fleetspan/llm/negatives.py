"""Hard-negative mining by anchor spanning-tree bounds.

The anchors of a block form a minimum spanning tree by Euclidean distance. For a candidate x, the score of an anchor a with the parent p is
<p, x> + <a - p, x>, so it lies within |a - p| |x| of the parent's score. Candidates are scored exactly at the root; at every other anchor the
parent's score, or its bounds, give bounds, and only candidates whose bounds meet a window of the anchor are scored again.

1. Positives: anchors and candidates of one label meet in blocks (labels with few rows share one). An anchor's window reaches from the least of
   its best scores so far upwards.
2. Floors: every block of anchors is held against one block of candidates. What an anchor finds there for a positive are rows
   that only better ones can replace.
3. Negatives: every block of anchors meets every block of candidates. A positive's window reaches from its floor, or from low percent of
   its score, to high percent of it. The best of all blocks are ranked together.

How much the bounds leave out depends on the data: anchors close to each other share nearly all their work, unrelated ones share none.

Defined results: rows with a null vec_id or label, a null vector, or null or non-finite components (before or after scaling) take no part. Of rows that share
a vec_id the one with the least vector, then label, counts. Shorter vectors count as padded with zeros. Equal scores are ordered by vec_id. Scores are exact
integers; those beyond a long count as the nearest long. With a negative positive score no negative fits. Anchors without positives or
without fitting negatives give no rows; empty tables give an empty result. Columns besides vec_id, label and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import met, stored

ANCHORS = 512
CANDIDATES = 4096
PIVOTS = 32
#: Products up to this are exact in doubles, and their bounds are off by far less than 1.
SMALL = 2.0**46
LONG = 2**63 - 1


def _matrix(column, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_buffer())
        out[i, : len(v)] = v
    return out


def _width(*columns) -> int:
    return max((len(x.as_buffer()) // 8 for c in columns for x in c), default=0)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order in which nodes join, each node's parent or -1, distance to it): Prim's algorithm from the node nearest to the mean."""
    n = len(x)
    parent, edge, order = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=int)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    near, best = np.full(n, -1), np.full(n, np.inf)
    out = np.ones(n, dtype=bool)
    for i in range(n):
        order[i], parent[at], out[at] = at, near[at], False
        edge[at] = np.sqrt(best[at]) if near[at] >= 0 else 0
        d = ((x - x[at]) ** 2).sum(axis=1)
        closer = out & (d < best)
        best[closer], near[closer] = d[closer], at
        if i < n - 1:
            at = int(np.where(out, best, np.inf).argmin())
    return order, parent, edge


class _Scores:
    """Exact scores of anchors q against candidates c."""

    def __init__(self, q: np.ndarray, c: np.ndarray):
        a, b = (float(np.abs(x).max(initial=0)) for x in (q, c))
        self.bounded = max(a * b * max(1, c.shape[1]), a, b) < SMALL
        if not self.bounded:
            q, c = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
        self.q, self.c = q, c

    def at(self, i: int, some: np.ndarray) -> np.ndarray:
        if self.bounded:
            c = self.c if len(some) == len(self.c) else self.c[some]
            return np.rint(c @ self.q[i]).astype(np.int64)
        return np.array([min(LONG, max(-LONG - 1, sum(a * b for a, b in zip(self.q[i], self.c[j])))) for j in some], dtype=np.int64)


def walk(q: np.ndarray, c: np.ndarray, wanted):
    """Go down the trees of the anchors q: yield (anchor, candidates that may be in its windows, their exact scores).

    wanted(i) gives the candidates that may count for anchor i (boolean) and its windows [(least, greatest)].
    """
    exact = _Scores(q, c)
    if not exact.bounded:
        for i in range(len(q)):
            some = np.flatnonzero(wanted(i)[0])
            yield i, some, exact.at(i, some)
        return
    everything = np.arange(len(c))
    cn, qn = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for start in range(0, len(q), ANCHORS):
        order, parent, edge = spanning_tree(q[start : start + ANCHORS])
        children = np.bincount(parent[parent >= 0], minlength=len(order))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of anchors whose children are still to come
        for j in order:
            i, p = start + j, parent[j]
            may, windows = wanted(i)
            if p < 0:
                some, score = everything, exact.at(i, everything)
                lo = hi = score.astype(np.float64)
            else:
                reach = edge[j] * cn * (1 + 1e-9) + 1  # with something for rounding
                most = qn[i] * cn * (1 + 1e-9) + 1
                lo, hi = np.maximum(bounds[p][0] - reach, -most), np.minimum(bounds[p][1] + reach, most)
                meets = np.zeros(len(c), dtype=bool)
                for a, b in windows:
                    meets |= (hi >= a) & (lo <= b)
                some = np.flatnonzero(meets & may)
                score = exact.at(i, some)
                lo[some] = hi[some] = score
                children[p] -= 1
                if not children[p]:
                    del bounds[p]
            if children[j]:
                bounds[j] = lo, hi
            counts = may[some]
            yield i, some[counts], score[counts]


def _anew(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns that share no origin with those of another table, as two sides of a cogroup need."""
    return rows.select(*(F.col(c).alias(c) for c in columns))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score (downwards), then id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], ~scores[near]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


def _table(columns: dict) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in columns.items()})


def _positives(k: int):
    def run(anchors, cands):
        out = {c: [] for c in ("anchor_id", "positive_id", "score")}
        if anchors.num_rows and cands.num_rows:
            d = _width(anchors.column("vec"), cands.column("vec"))
            q, c = _matrix(anchors.column("vec"), d), _matrix(cands.column("vec"), d)
            aid, alabel = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
            cid, clabel = cands.column("vec_id").to_numpy(), cands.column("label").to_numpy()
            # the k-th best of an anchor's first candidates is a floor of its window
            first = _Scores(q, c[: 16 * k])

            def wanted(i):
                may = (clabel == alabel[i]) & (cid != aid[i])
                some = np.flatnonzero(may[: 16 * k])
                floor = np.sort(first.at(i, some))[-k] if first.bounded and len(some) >= k else -np.inf
                return may, [(floor, np.inf)]

            for i, some, score in walk(q, c, wanted):
                top = _best(cid[some], score, k)
                out["anchor_id"].append(np.full(len(top), aid[i]))
                out["positive_id"].append(cid[some[top]])
                out["score"].append(score[top])
        return _table(out)

    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors, cands):
        out = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if anchors.num_rows and cands.num_rows:
            d = _width(anchors.column("vec"), cands.column("vec"))
            q, c = _matrix(anchors.column("vec"), d), _matrix(cands.column("vec"), d)
            aid, alabel = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
            cid, clabel = cands.column("vec_id").to_numpy(), cands.column("label").to_numpy()
            positives = anchors.column("positives").to_pylist()
            spans = []
            for of in positives:
                ends = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in of]
                # a floor is the k-th best that another block holds
                spans.append([(a if p["floor"] is None else max(a, p["floor"]), b) for p, (a, b) in zip(of, ends)])

            for i, some, score in walk(q, c, lambda i: (clabel != alabel[i], [x for x in spans[i] if x[0] <= x[1]])):
                ids = cid[some]
                order = np.lexsort((ids, ~score))
                falling = score[order]
                for p, (a, b) in zip(positives[i], spans[i]):
                    at = int(np.searchsorted(~falling, ~np.int64(min(LONG, max(-LONG - 1, b)))))  # ~ turns the order round
                    top = order[at : at + k]
                    top = top[score[top] >= a] if a <= b else top[:0]
                    out["anchor_id"].append(np.full(len(top), aid[i]))
                    out["positive_id"].append(np.full(len(top), p["id"]))
                    out["positive_score"].append(np.full(len(top), p["score"]))
                    out["negative_id"].append(ids[top])
                    out["negative_score"].append(score[top])
        return _table(out)

    return run


def _rows(vectors: DataFrame, is_anchor: Column, scale: int, most: int) -> DataFrame:
    """vec_id, label, vec (bytes of doubles), anchor. Of equal vectors of a label only the first `most` ids, which any result can name, and the anchors stay."""
    inf = F.lit(float("inf"))
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    # from 2^53 on doubles are integers
    whole = F.transform("e", lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    sound = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("e")).filter("vec_id is not null and label is not null").filter(sound)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(whole.alias("vec"), "label")).alias("x")).select("vec_id", "x.label", "x.vec", is_anchor.alias("anchor"))
    copies = Window.partitionBy("label", F.xxhash64("vec"), "vec").orderBy("vec_id")
    # row_number up to a constant is cut before and after the shuffle, so a large group of copies never meets in one task
    first = rows.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= most).drop("nth").withColumn("cand", F.lit(True))
    rows = first.unionByName(rows.filter("anchor").withColumn("cand", F.lit(False)))

    def packed(batches):
        for batch in batches:
            raw = pa.array([np.array(v.as_py(), dtype=np.float64).tobytes() for v in batch.column("vec")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "anchor", "cand")), raw], ["vec_id", "label", "anchor", "cand", "vec"])

    return stored(rows.mapInArrow(packed, "vec_id long, label long, anchor boolean, cand boolean, vec binary"), "vectors")


def _nearest(rows: DataFrame, pivots: list[bytes]) -> DataFrame:
    """rows and cell, the nearest pivot."""

    def run(batches):
        for batch in batches:
            d = max(_width(batch.column("vec")), *(len(p) // 8 for p in pivots))
            x, p = _matrix(batch.column("vec"), d), _matrix(pa.array(pivots, pa.binary()), d)
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.stack([((x - y) ** 2).sum(axis=1) for y in p], axis=1).argmin(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor: a Column over vec_id. Components x become floor(scale * x). An anchor's positives are its best rows of the same label; for each, the best rows of other labels with
    low * positive <= 100 * negative <= high * positive.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, is_anchor, scale, max(positives + 1, negatives))
    cands, anchors = rows.filter("cand").drop("cand", "anchor"), rows.filter("anchor and not cand").drop("cand", "anchor")
    n, m = cands.count(), anchors.count()
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not m:
        return spark.createDataFrame([], names)

    # 1. labels with up to CANDIDATES rows share cells of about so many; larger ones have blocks of their own
    sizes = cands.groupBy("label").agg(F.count("*").alias("n")).join(anchors.groupBy("label").agg(F.count("*").alias("m")), "label")
    large = F.col("n") > CANDIDATES
    group = F.concat(F.when(large, "l").otherwise("s"), F.when(large, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(n / CANDIDATES))))).cast("string"))
    sizes = stored(sizes.select("label", group.alias("g"), F.when(large, F.ceil(F.col("n") / CANDIDATES)).otherwise(1).alias("bs"), F.when(large, F.ceil(F.col("m") / ANCHORS)).otherwise(1).alias("qs"), (F.col("n") + F.col("m")).alias("size")), "labels")
    b = met(cands, sizes, ["label"]).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("bs"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    q = met(anchors, sizes, ["label"]).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("qs"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bs") - 1)))
    key = ["g", "q", "b"]
    near = _anew(q, "vec_id", "label", "vec", *key).groupBy(*key).cogroup(b.select("vec_id", "label", "vec", *key).groupBy(*key)).applyInArrow(_positives(positives), "anchor_id long, positive_id long, score long")
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives"))  # positives rows at most

    # 2. and 3.: anchors in blocks by their nearest pivot, candidates in blocks by hash
    pivots = [bytes(r["vec"]) for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, math.ceil(m / ANCHORS))).collect()]
    asked = _nearest(anchors.join(near.hint("merge"), F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", "positives"), pivots)
    asked = stored(asked, "anchors")
    counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a pivot
    blocks = F.array(*(F.lit(max(1, math.ceil(counts.get(c, 0) / ANCHORS))) for c in range(len(pivots))))
    asked = asked.withColumn("q", F.col("cell").cast("long") * (1 << 40) + F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("cell") + 1)))
    nb = max(1, math.ceil(n / CANDIDATES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(nb))
    cands = cands.withColumn("b", block)
    # the stated anchors against all rows, in blocks: (block of anchors, block of candidates), which joins both sides by equality
    pairs = asked.select("q").distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long")))).withColumn("own", F.col("b") == F.pmod(F.xxhash64("q"), F.lit(nb)))
    pairs = stored(pairs, "pairs")

    def searched(q: DataFrame, some: DataFrame) -> DataFrame:
        left = _anew(q.join(some.hint("merge"), "q"), "vec_id", "label", "vec", "positives", "q", "b")
        right = cands.join(some.hint("merge"), "b").select("vec_id", "label", "vec", "q", "b")
        return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(_negatives(negatives, low, high), schema)

    plain = asked.withColumn("positives", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"), F.lit(None).cast("long").alias("floor"))))
    first = stored(searched(plain, pairs.filter("own").select("q", "b")), "first")
    floors = first.groupBy("anchor_id", "positive_id").agg(F.min("negative_score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == negatives)
    floors = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "floor"))).alias("floors"))  # positives rows at most
    sharp = asked.join(floors.withColumnRenamed("anchor_id", "vec_id").hint("merge"), "vec_id", "left")
    sharp = sharp.withColumn("positives", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"), F.try_element_at("floors", p["id"]).alias("floor"))))
    found = first.union(searched(sharp, pairs.filter("not own").select("q", "b")))
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
