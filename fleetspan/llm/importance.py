"""Target-distribution importance resampling: documents drawn by the log-ratio of two bags of hashed n-grams, with Gumbel noise.

1. One pass over each corpus counts n-grams by bucket: crc32 of their UTF-8 bytes, modulo a fixed number of buckets.
2. The gains of all buckets make one array of that fixed size. It travels with the tasks that score documents in a second pass.
3. The cutoff is bracketed by a quantile sketch of the scores. Exact counts outside the bracket tell whether it holds the wanted place; if not, it
   is widened, in the end to all scores. Only rows in the bracket are ranked to find the cutoff.
4. Ranks come from a range partitioning, sorted range by range, and a table of the ranges' sizes; no task sees all drawn rows.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased; features are runs of 1 to max_n words joined by a space.

Defined results: null and empty texts have no feature, weight 0 and are never drawn unless min_words is 0. A null doc_id is hashed as an empty
string and comes after all others among equal scores. Repeated rows are rows of their own; those of one doc_id and score are ordered by n_features.
An empty corpus has counts of 0. Empty tables give an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

BUCKETS = 10000
#: Distinct features whose gains a task keeps at hand.
KNOWN = 1 << 18
#: Every byte of no word is a space, A-Z are a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ORDER = [F.desc, F.asc_nulls_last, F.asc, F.asc]
COLUMNS = ["score", "doc_id", "n_features", "row"]


def features(text: str | None, max_n: int = 1) -> tuple[list[bytes], int]:
    """(features with repeats, number of words)."""
    words = (text or "").encode().translate(LETTERS).split()
    out = words
    for n in range(2, max_n + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out, len(words)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_n: int = 1) -> list[int]:
    """Features of all texts by bucket: one list of a fixed length."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(features(text, max_n)[0])
            for feature, n in seen.items():
                total[zlib.crc32(feature) % buckets] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = [0] * buckets
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log-ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    k, big_s, big_t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(big_s + k) / (float(s + 1) * float(big_t + k)))) for s, t in zip(source, target)]


class _Gains(dict):
    """Gain by feature, filled as features are met and emptied when it holds KNOWN of them."""

    def __init__(self, by_bucket):
        self.by_bucket = by_bucket

    def __missing__(self, feature):
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = g = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return g


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths that follows from seed and doc_id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, by_bucket: list[int], seed: int, max_n: int = 1) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""

    def run(batches):
        gain = _Gains(by_bucket)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, words = features(text, max_n)
                weight = sum(map(gain.__getitem__, found)) // len(found) if found else 0
                out.append((len(found), words, weight, weight + noise(doc_id, seed)))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def ranked(rows: DataFrame, rank: str) -> DataFrame:
    """rows with their place (from 1) in the order of COLUMNS: ranges sorted one by one, and the sizes of the ranges before."""
    order = [f(c) for f, c in zip(ORDER, COLUMNS)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    sizes = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(rank, place).drop("_part", "_before", "_at")


def bracket(scored: DataFrame, wanted: int, total: int, margin: float = 0.005, accuracy: int = 10000) -> tuple[int, int, int]:
    """(lo, hi, rows above hi) such that the wanted-th highest score is in [lo, hi]: places of a quantile sketch, held against exact counts
    and widened until they fit. Ends after log2(1 / margin) rounds at most."""
    at = 1 - wanted / total
    while True:
        ends = [min(1.0, max(0.0, x)) for x in (at - margin, at + margin)]
        lo, hi = scored.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        if ends == [0.0, 1.0]:  # the sketch may miss the very ends
            lo, hi = scored.agg(F.min("score"), F.max("score")).first()
        above, inside = scored.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < wanted <= above + inside:
            return lo, hi, above
        margin *= 2


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, max_n: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 for drawn rows, else null) of every row of docs.

    Of the rows with at least min_words words, percent in a hundred (rounded down) with the highest scores are drawn; ties go to the smaller doc_id.
    """
    by_bucket = gains(bucket_counts(docs, buckets, max_n), bucket_counts(target, buckets, max_n))
    scored = stored(scores(docs, by_bucket, seed, max_n).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    total = able.count()
    wanted = total * percent // 100
    kept = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*kept, F.lit(None).cast("long").alias("rank"))
    lo, hi, above = bracket(able, wanted, total)
    inside = stored(ranked(able.filter(F.col("score").between(lo, hi)), "place"), "bracket")
    # rows up to the cutoff's place in the bracket join those above it
    drawn = able.filter(F.col("score") > hi).union(inside.filter(F.col("place") <= wanted - above).select(*scored.columns))
    drawn = ranked(drawn, "rank").select(*kept, F.col("rank").cast("long").alias("rank"))
    left = scored.filter((F.col("n_words") < min_words) | (F.col("score") < lo)).union(inside.filter(F.col("place") > wanted - above).select(*scored.columns))
    return drawn.union(left.select(*kept, F.lit(None).cast("long").alias("rank")))
