"""Quality classifier: a sparse rule ensemble.

Text statistics are computed for each whole document. A random forest is fitted on labelled rows; every path from a root to an
inner node or leaf of its trees is a conjunctive rule over the statistics. A lasso logistic regression over the rules' indicators
keeps few of them; the kept rules and weights become one Spark column expression, which scores any table with the statistics.

The statistics are general ones of text quality (length, shares of character classes, repetition of words, triples and lines). Shares of pipes and of
words that end in symbols tell tables and markup from prose; a neighbouring word repeated tells loops. None of them is a threshold set by hand: the forest
picks from them, and the lasso drops what labels don't support.

Labels are learned from FIT_ROWS labelled rows at most (those with the smallest hash of doc_id), none of them held out, that is,
with crc32(doc_id as text) mod 5 = 0. Scores depend on the text alone.

Defined results: null text counts as empty; an empty text has all statistics 0 and a score like any other. A doc_id that repeats is
scored row by row; a null doc_id is not held out. Repeated labels of a doc_id are averaged, a tie counts as 1; null labels are left
out. Where all labels are alike every score is near that label (1 / (1 + e^20) from it), and 0.5 without labels. Empty tables give empty results. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fresh, stored

STATS = ("log_words", "mean_word", "upper_share", "symbol_share", "digit_share", "punct_share", "line_words", "pipe_share", "distinct_words", "repeat_next", "distinct_triples", "distinct_lines", "longest_word", "symbol_words")
FIT_ROWS = 20_000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 upper, 2 symbol, 3 digit, 4 punctuation, 5 newline, 6 pipe, 7 blank."""
    c = np.zeros(256, dtype=np.uint8)
    c[65:91] = 1
    for group, k in (("#$%&*!<>=+~^@_{}[]\\/", 2), ("0123456789", 3), (".,;:?'\"()-", 4), ("\n", 5), ("|", 6), (" \t\r\f\v", 7)):
        c[[ord(x) for x in group]] = k
    return c


def text_stats(col: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    kinds = _classes()
    out = np.zeros((len(col), len(STATS)))
    offs, data = tk._buffers(col)
    for i, j, h, o in tk.word_hashes(col):
        for r in range(i, j):
            b, w = data[offs[r] : offs[r + 1]], h[o[r - i] : o[r - i + 1]]
            n = len(w)
            if not n:
                continue
            k = kinds[b]
            c = np.bincount(k, minlength=8)
            solid = max(1, len(b) - c[5] - c[7])
            letters = (k == 0) | (k == 1)
            # a word that ends in a symbol: a symbol before white space or the end
            last = np.append(k[1:] == 7, True) | np.append(k[1:] == 5, True)
            ends = np.count_nonzero((k == 2) & last)
            gaps = np.flatnonzero((k == 5) | (k == 7))
            edges = np.diff(np.concatenate([[-1], gaps, [len(b)]])) - 1
            triples = tk.shingles(w, 3)
            lines = np.flatnonzero(k == 5)
            whole = data[offs[r] : offs[r + 1]].tobytes().split(b"\n") if len(lines) else [b""]
            out[r] = (np.log1p(n), solid / n, c[1] / max(1, np.count_nonzero(letters)), c[2] / solid, c[3] / solid, c[4] / solid, np.log1p(n / (c[5] + 1)), c[6] / n,
                      len(np.unique(w)) / n, np.count_nonzero(w[1:] == w[:-1]) / n, len(np.unique(triples)) / len(triples), len(set(whole)) / len(whole), np.log1p(edges.max()), ends / n)
    return out


def with_stats(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns keys of docs and the statistics of its text."""
    schema = docs.select(*keys).schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{s} double" for s in STATS)])

    def run(batches):
        for batch in batches:
            x = text_stats(batch.column(len(keys)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(x[:, i]) for i in range(len(STATS)))], [*keys, *STATS])

    return docs.select(*keys, "text").mapInArrow(run, ddl)


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold)."""

    terms: tuple

    def column(self) -> Column:
        out = None
        for name, above, at in self.terms:
            t = F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at)
            out = t if out is None else out & t
        return out.cast("double")


def tree_rules(model) -> list[Rule]:
    """All distinct paths of a fitted forest."""
    found: dict = {}

    def walk(node, path):
        if path:
            merged: dict = {}
            for name, above, at in path:  # of several bounds of a statistic the tightest counts
                old = merged.get((name, above))
                merged[name, above] = at if old is None else max(old, at) if above else min(old, at)
            found[Rule(tuple((n, a, t) for (n, a), t in sorted(merged.items())))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = STATS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*path, (name, False, at)])
            walk(node.rightChild(), [*path, (name, True, at)])

    for tree in model.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple  # (Rule, weight)

    def score(self) -> Column:
        """Probability of label 1 from the columns STATS."""
        z = F.lit(float(self.intercept))
        for rule, w in self.weights:
            z = z + F.lit(float(w)) * rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS, trees: int = 16, depth: int = 3, lasso: float = 0.002) -> RuleEnsemble:
    """Learn from labelled rows of docs that are not held out, fit_rows at most."""
    marks = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("double").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_id"), "label")
    # fit_rows bounds the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "label")
    rows = stored(with_stats(rows, ["label"]), "quality-fit").coalesce(4)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(0.0 if not n else 20.0 if ones else -20.0, ())
    data = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(rows).select("x", "label", *STATS).persist()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=7).fit(data)
    rules = tree_rules(forest)
    named = data.select("label", *(r.column().alias(f"r{i}") for i, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="z").transform(named).select("z", "label").persist()
    model = LogisticRegression(featuresCol="z", labelCol="label", regParam=lasso, elasticNetParam=1.0, standardization=True, maxIter=60).fit(fired)
    data.unpersist()
    fired.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleEnsemble(float(model.intercept), tuple(weights))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    s = with_stats(docs, ["doc_id"])
    return s.select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model takes for good, with all columns. The row itself goes through with its statistics."""
    schema = docs.schema
    text = docs.columns.index("text")
    extra = {s: fresh(docs, s) for s in STATS}
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"`{extra[s]}` double" for s in STATS)])

    def run(batches):
        for batch in batches:
            x = text_stats(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:, i]) for i in range(len(STATS)))], [*batch.schema.names, *extra.values()])

    ensemble = RuleEnsemble(model.intercept, tuple((Rule(tuple((extra[n], a, t) for n, a, t in r.terms)), w) for r, w in model.weights))
    return docs.mapInArrow(run, ddl).filter(ensemble.score() >= threshold).select(*docs.columns)
