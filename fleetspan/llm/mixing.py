"""Soft-membership mixing.

Every document belongs to each domain with a posterior probability. The domains are the classes of the labels table: quality (0, 1) by
toxic (0, 1). A softmax regression over hashed words, fitted on FIT_ROWS labelled rows at most, gives the posteriors. A document's
expected tokens in a domain are its words t times its posterior p. Rates r >= 0, one a document, then minimise the sum over domains of
(sum t p r - goal)^2 / goal, by projected gradient descent from r = 1: a step moves each document against its posteriors times a vector, and cuts at 0.
That vector is the gradient in the metric of the documents that are not at 0, which meets goals that can be met in a few passes, each
step halved until it gains. A pass needs the domains' totals and their Gram matrix only: one vector a task.

Goals that can't be met have no sensible least squares: a few documents at the edge would take the place of all others. So RIDGE times
sum t (r - 1)^2 is added, and the optimum is the projection of 1 - p y on r >= 0 for one price y a domain, found by Newton steps on the
prices, again one vector a task and pass, and one step to replay. It ends when the projected gradient vanishes within TOLERANCE, which proves the optimum;
what is left is in the result, and a warning tells of it.

Goals are the targets' shares of the tokens there are, or, with keep, of as many tokens as leave that domain what it has.
Rates become copies by the fraction of a hash of doc_id and text: floor(rate + fraction).

Defined results: null or empty text has no tokens, the prior as posterior and a rate of 1. Rows that repeat, doc_id and text alike, are mixed one
by one, and share their fraction; null doc_ids differ by their texts. Without labels all posteriors are equal and only the total can be met.
A target of 0 draws its domain down as far as the others let it. Empty tables give empty results. Other columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, fresh, stored

DOMAINS = ("junk", "junk_toxic", "clean", "clean_toxic")
#: Share of all tokens that each domain shall have. Clean text keeps its weight, the rest is drawn down to a little.
TARGETS = {"junk": 0.01, "junk_toxic": 0.005, "clean": 0.96, "clean_toxic": 0.025}
FIT_ROWS = 3_000
#: Rates are held to at most this. A finite bound may make targets infeasible.
MOST = math.inf
HASHES = 1 << 13
#: Passes of the descent at most, of which the second kind begins after half of them; most targets take fewer than ten, others fewer than twenty.
ROUNDS = 60
#: Weight of a rate's square distance from 1, against the squares of the domains' shares.
RIDGE = 1e-4
TOLERANCE = 1e-6


def _features(w: np.ndarray) -> np.ndarray:
    """Distinct hashed words of a text; words of several kinds of repetition share slots of their own."""
    kinds = (w >> np.uint64(64 - 13)).astype(np.int64)
    found = np.unique(kinds)
    again = np.count_nonzero(w[1:] == w[:-1]) / max(1, len(w))
    return np.append(found, HASHES + min(7, int(again * 8)))


def posterior_fn(weights: np.ndarray, bias: np.ndarray):
    def posteriors(h, o):
        out = np.empty((len(o) - 1, len(bias)))
        for r in range(len(o) - 1):
            w = h[o[r] : o[r + 1]]
            z = bias + (weights[_features(w)].mean(axis=0) * 100 if len(w) else 0)
            z = np.exp(z - z.max())
            out[r] = z / z.sum()
        return out

    return posteriors


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the domain classifier, from fit_rows labelled rows at most (smallest hash of doc_id)."""
    marks = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((2 * (F.avg("quality") >= 0.5).cast("int") + (F.avg("toxic") >= 0.5).cast("int")).alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "_id")  # fit_rows bounds the broadcast

    def bag(batches):
        for batch in batches:
            cells = []
            for i, j, h, o in tk.word_hashes(batch.column(1)):
                cells += [_features(h[o[r] : o[r + 1]]).astype(np.int16) for r in range(j - i)]
            offs = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int16)))], ["y", "cells"])

    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).orderBy("_id")
    rows = rows.select("y", "text").mapInArrow(bag, "y int, cells array<smallint>").toArrow()
    k = len(DOMAINS)
    weights, bias = np.zeros((HASHES + 8, k)), np.zeros(k)
    if not rows.num_rows:
        return weights, bias
    y = np.eye(k)[rows.column("y").to_numpy()]
    lists = rows.column("cells").combine_chunks()
    n = lists.value_lengths().to_numpy()
    cell, row, scale = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n), 100.0 / n
    share = y.mean(axis=0)
    bias = np.log(share + 1e-3)
    size, last = np.full(weights.shape, 0.01), np.zeros_like(weights)
    weights, bias, y, scale = (x.astype(np.float32) for x in (weights, bias, y, scale))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    order = np.argsort(cell, kind="stable")
    cuts = np.searchsorted(cell[order], np.arange(HASHES + 8))
    for _ in range(rounds):
        z = bias + np.add.reduceat(weights[cell], starts, axis=0) * scale[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        err = (y - z / z.sum(axis=1, keepdims=True)) * scale[:, None]
        sums = np.vstack([np.zeros((1, k)), np.cumsum(err[row[order]], axis=0, dtype=np.float64)])
        grad = sums[np.append(cuts[1:], len(cell))] - sums[cuts] - 2.0 * weights
        same = grad * last
        size = np.where(same > 0, np.minimum(size * 1.2, 0.2), np.where(same < 0, size * 0.5, size))
        weights += np.where(same >= 0, np.sign(grad) * size, 0)
        last = np.where(same >= 0, grad, 0)
    return weights, bias


def memberships(docs: DataFrame, model) -> DataFrame:
    """doc_id, tokens and the posteriors p0.. of each row; with the key columns given in docs before text."""
    weights, bias = model
    keys = [c for c in docs.columns if c != "text"]
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != "text"), "tokens long", *(f"p{i} double" for i in range(len(DOMAINS)))])

    def run(batches):
        posteriors = posterior_fn(weights, bias)
        for batch in batches:
            p, n = [], []
            for _, _, h, o in tk.word_hashes(batch.column(len(keys))):
                p.append(posteriors(h, o))
                n.append(np.diff(o))
            if p:
                p = np.concatenate(p)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.concatenate(n), pa.int64()), *(pa.array(p[:, i]) for i in range(len(DOMAINS)))], [*keys, "tokens", *(f"p{i}" for i in range(len(DOMAINS)))])

    return docs.select(*keys, "text").mapInArrow(run, ddl)


def _rates(tokens: np.ndarray, p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Rates after the steps so far; a step holds a momentum and what a document moves by, times its posteriors."""
    r = last = np.ones(len(tokens))
    for momentum, s in steps:
        r, last = np.clip(r + momentum * (r - last) - p @ s, 0.0, MOST), r
    return np.where(tokens > 0, r, 1.0)


@dataclass
class Solution:
    """Steps to the rates, and what they come to: goals and totals in tokens by domain, the projected gradient's size, passes."""

    steps: list = field(default_factory=list)
    goals: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    totals: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    gradient: float = 0.0
    passes: int = 0
    met: bool = True

    def residuals(self) -> dict[str, float]:
        """Share of all wanted tokens by which each domain is off."""
        return {d: float(x) for d, x in zip(DOMAINS, (self.totals - self.goals) / max(1.0, self.goals.sum()))}


def solve(members: DataFrame, targets: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep: str | None = None) -> Solution:
    """Least-squares rates for targets (shares, scaled to add up to 1). members: a stored table of tokens and posteriors."""
    k = len(DOMAINS)
    names = [f"p{i}" for i in range(k)]
    upper = np.triu_indices(k)
    cols = [*(f"g{i}" for i in range(k)), *(f"m{i}" for i in range(len(upper[0]))), "dual"]

    def run(steps, prices):
        """Totals, Gram matrix of the documents above 0, and the sum of (r - 1)^2 / 2 and of r times the prices of its domains."""

        def part(batches):
            got = np.zeros(len(cols))
            for batch in batches:
                t = batch.column(0).to_numpy().astype(np.float64)
                p = np.stack([batch.column(1 + i).to_numpy() for i in range(k)], axis=1)
                r = _rates(t, p, steps)
                inside = ((r > 0) & (r < MOST)) * t
                got += np.concatenate([(r * t) @ p, ((p * inside[:, None]).T @ p)[upper], [(t * ((r - 1) ** 2 / 2 + r * (p @ prices))).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], cols)

        got = members.select("tokens", *names).mapInArrow(part, ", ".join(f"{c} double" for c in cols)).agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in cols)).first()
        gram = np.zeros((k, k))
        gram[upper] = gram.T[upper] = got[k:-1]
        return np.array(got[:k]), gram, got[-1]

    totals, full, _ = run([], np.zeros(k))
    total = totals.sum()
    if not total:
        return Solution()
    wanted = np.array([targets[d] for d in DOMAINS])
    wanted = wanted / wanted.sum()
    if keep is not None and wanted[i := DOMAINS.index(keep)]:
        total = totals[i] / wanted[i]
    goals = total * wanted
    weight = 1 / np.maximum(goals, tolerance * total)
    full += 1e-12 * np.trace(full) * np.eye(k)
    steps, gram, passes = [], full, 1
    loss = lambda left, m: left @ m @ left
    met = lambda now: bool(np.abs(now - goals).max() <= tolerance * total)
    # the metric of the documents that may move
    while passes < rounds // 2 and not met(totals):
        metric = np.linalg.inv(gram + 1e-3 * full)
        step, size, left = metric @ (totals - goals), 1.0, totals - goals
        while size >= 1e-3:
            new, new_gram, _ = run([*steps, (0.0, size * step)], np.zeros(k))
            passes += 1
            if loss(new - goals, metric) <= loss(left, metric) * (1 - 1e-2 * size):
                break
            size /= 4
        else:
            break
        steps, totals, gram = [*steps, (0.0, size * step)], new, new_gram
    # goals that can't be met: a Newton method for the sum of squares and its ridge, which has one optimum
    slope = math.inf
    if not met(totals):
        bend = np.diag(RIDGE / weight)
        move, size, known = np.zeros(k), 1.0, None
        while passes < rounds:
            trial = move if known is None else move + size * step
            new, new_gram, value = run([(0.0, trial)], trial)
            passes += 1
            value -= trial @ goals + trial @ bend @ trial / 2
            if known is not None and value < known + 1e-4 * size * (left @ step) - 1e-12 * abs(known):
                size /= 4
                continue
            move, known, totals, size = trial, value, new, 1.0
            left = totals - goals - bend @ move
            slope = math.sqrt(max(0.0, (weight * left) @ full @ (weight * left)) / total)
            if slope <= tolerance:
                break
            step = np.linalg.solve(new_gram + bend, left)
        steps = [(0.0, move)]
    out = Solution(steps, goals, totals, 0.0 if slope is math.inf else slope, passes, met(totals))
    if not out.met:
        warnings.warn(f"mixing: targets are not met ({'infeasible' if out.gradient <= tolerance else 'passes used up'}); off by these shares of all tokens: {out.residuals()}", stacklevel=2)
    return out


def rated(members: DataFrame, steps: list[tuple[float, np.ndarray]], keys: list[str]) -> DataFrame:
    """members with the column rate."""
    k = len(DOMAINS)
    names = [*keys, "tokens", *(f"p{i}" for i in range(k))]
    kinds = dict(members.dtypes)

    def run(batches):
        for batch in batches:
            t = batch.column(len(keys)).to_numpy().astype(np.float64)
            p = np.stack([batch.column(len(keys) + 1 + i).to_numpy() for i in range(k)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(t, p, steps))], [*names, "rate"])

    return members.select(*names).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", rate double")


def fraction(doc_id, text_hash) -> F.Column:
    """A number in [0, 1) that depends on doc_id and text."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0)), text_hash, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)


def copies_of(rate, doc_id, text_hash) -> F.Column:
    # a rate within rounding of a whole number counts as that number
    return F.floor(F.round(rate, 6) + fraction(doc_id, text_hash)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: str | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>, rate, copies."""
    model = fit(docs, labels)
    members = stored(memberships(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), model), "memberships")
    out = rated(members, solve(members, targets, keep=keep).steps, ["doc_id", "h"])
    return out.select("doc_id", "tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", copies_of(F.col("rate"), F.col("doc_id"), F.col("h")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: str | None = None) -> DataFrame:
    """The rows of docs, each as many times as its rate says, with all columns."""
    model = fit(docs, labels)
    members = stored(memberships(docs.select("text"), model), "memberships")
    steps = solve(members, targets, keep=keep).steps
    discard(members)
    rate, n = fresh(docs, "_rate"), fresh(docs, "_copies")
    weights, bias = model
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        posteriors = posterior_fn(weights, bias)
        for batch in batches:
            r = [np.zeros(0)]
            for _, _, h, o in tk.word_hashes(batch.column(at)):
                r.append(_rates(np.diff(o).astype(np.float64), posteriors(h, o), steps))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(r))], [*names, rate])

    ddl = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{rate}` double"
    out = docs.mapInArrow(run, ddl).withColumn(n, copies_of(F.col(rate), F.col("doc_id"), F.xxhash64("text")))
    return out.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*names)


def summary(rows: DataFrame) -> str:
    """Domains' shares of tokens before and after, as JSON; for reports and tests."""
    cols = [F.sum(F.col("tokens") * F.col(f"p_{d}") * w).alias(f"{d}_{k}") for d in DOMAINS for k, w in (("before", F.lit(1.0)), ("after", F.col("rate")))]
    return json.dumps(rows.agg(*cols).first().asDict())
