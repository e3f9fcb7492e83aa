"""Logistic fits of all folds, replicates and classes at once.

A row carries one weight (and, if targets differ, one target) per fit. Each proximal Newton step needs the gradient and the Gram matrix of
every fit, and both come from one aggregation over the rows: a task adds up its rows for all fits, and only these sums, which grow with the
number of coefficients, are shuffled and come to the driver. So the number of Spark jobs doesn't depend on the number of fits.

A fit prepares its columns by its own training rows: medians for missing numbers, then centre and scale; the most frequent level for missing
categories, and one shared level for those seen less than `least` times. A fit minimises, per unit of weight, the logistic loss plus
l2 / 2 |b|^2 + l1 |b|_1 of its coefficients on prepared columns; the intercept is free. It ends when all conditions of the optimum hold within `tolerance`.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles

#: Levels that a category may have.
LEVELS = 10_000
OTHER = "other"


@dataclass(frozen=True)
class Logistic:
    """Penalties per unit of weight; balance: both classes weigh the same in every fit."""

    l2: float = 0.0
    l1: float = 0.0
    balance: bool = False


@dataclass
class Preparation:
    """What each fit learnt of its columns; first axis: fits."""

    numeric: list[str]
    categorical: list[str]
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    levels: list[list[str]] = field(default_factory=list)  # of each category, in order; then OTHER
    kept: list[list[set]] = field(default_factory=list)  # by fit and category
    mode: list[list[str]] = field(default_factory=list)

    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, vs in zip(self.categorical, self.levels) for v in [*vs, OTHER])]

    def matrix(self, numbers: np.ndarray, cats: list, fit: int) -> np.ndarray:
        """Prepared columns of one fit, and a last one of ones. numbers: rows by columns, nan where missing; cats: dictionary arrays."""
        x = np.where(np.isnan(numbers), self.median[fit], numbers)
        parts = [(x - self.mean[fit]) * self.scale[fit]]
        for j, (codes, values) in enumerate(cats):
            place = {v: i for i, v in enumerate(self.levels[j])}
            known = [place[v] if v in self.kept[fit][j] else len(place) for v in values]
            missing = place.get(self.mode[fit][j], len(place))
            at = np.array([*known, missing])[np.where(codes < 0, len(known), codes)]
            one = np.zeros((len(codes), len(place) + 1))
            one[np.arange(len(codes)), at] = 1
            parts.append(one)
        return np.hstack([*parts, np.ones((len(numbers), 1))])


def _numbers(batch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1) if columns else np.zeros((batch.num_rows, 0))


def _categories(batch, columns: list[str]) -> list:
    out = []
    for c in columns:
        d = batch.column(c).dictionary_encode()
        out.append((d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()))
    return out


def _lists(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def _summed(rows: DataFrame, n_fits: int, part) -> np.ndarray:
    """Sum over all rows of part(batch), an array with a row a fit."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_fits, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["fit", "values"])

    parts = rows.mapInArrow(run, "fit int, values array<double>").select("fit", F.posexplode("values").alias("at", "value"))
    found = parts.groupBy("fit", "at").agg(F.sum("value").alias("value")).collect()  # as many rows as the fits have sums
    out = np.zeros((n_fits, max((r["at"] for r in found), default=-1) + 1))
    for r in found:
        out[r["fit"], r["at"]] = r["value"]
    return out


def prepare(work: DataFrame, numeric: list[str], categorical: list[str], n_fits: int, least: int) -> Preparation:
    """work: columns w (weights by fit), numeric (doubles) and categorical (strings)."""
    each = work.select(F.posexplode("w").alias("fit", "_w"), *numeric, *categorical).filter("_w > 0")
    median = np.zeros((n_fits, len(numeric)))
    if numeric:
        for r in quantiles(each, ["fit"], [(f"_m{i}", c, 0.5) for i, c in enumerate(numeric)]).collect():  # a row a fit
            median[r["fit"]] = [r[f"_m{i}"] or 0.0 for i in range(len(numeric))]
    kept = [[set() for _ in categorical] for _ in range(n_fits)]
    mode = [[OTHER for _ in categorical] for _ in range(n_fits)]
    if categorical:
        long = each.select("fit", F.explode(F.array(*(F.struct(F.lit(j).alias("c"), F.col(c).alias("v")) for j, c in enumerate(categorical)))).alias("x")).select("fit", "x.c", "x.v")
        counts = long.filter("v is not null").groupBy("fit", "c", "v").count().filter(F.col("count") >= least)
        most = n_fits * len(categorical) * LEVELS
        found = counts.orderBy("fit", "c", F.desc("count"), "v").limit(most + 1).collect()  # a dimension's levels: few by nature
        if len(found) > most:
            raise ValueError(f"{categorical} have more than {LEVELS} levels; they are no categories")
        for r in found:
            if not kept[r["fit"]][r["c"]]:
                mode[r["fit"]][r["c"]] = r["v"]
            kept[r["fit"]][r["c"]].add(r["v"])
    levels = [sorted(set().union(*(kept[m][j] for m in range(n_fits)))) for j in range(len(categorical))]
    out = Preparation(numeric, categorical, median, np.zeros_like(median), np.ones_like(median), levels, kept, mode)

    def moments(batch):
        x, w = _numbers(batch, numeric), _lists(batch.column("w"), n_fits)
        made = []
        for m in range(n_fits):
            v = np.where(np.isnan(x), median[m], x) - median[m]
            made.append(np.concatenate([[w[:, m].sum()], w[:, m] @ v, w[:, m] @ (v * v)]))
        return np.array(made)

    if numeric:
        s, k = _summed(work, n_fits, moments), len(numeric)
        if s.size:
            n = np.maximum(s[:, :1], 1e-300)
            off = s[:, 1 : k + 1] / n
            sd = np.sqrt(np.maximum(s[:, k + 1 :] / n - off * off, 0))
            out.mean, out.scale = median + off, np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0)
    return out


@dataclass
class Fits:
    """Coefficients on prepared columns (fits by columns), intercepts, and how far the conditions of the optimum are missed."""

    preparation: Preparation
    coefficients: np.ndarray
    intercepts: np.ndarray
    violation: np.ndarray
    steps: int

    def apply(self, rows: DataFrame, keep: list[str], which: Column | None = None) -> DataFrame:
        """The columns keep, which (fits by number) and scores (the probabilities of these fits) of each row."""
        prep, b = self.preparation, np.hstack([self.coefficients, self.intercepts[:, None]])
        which = F.sequence(F.lit(0), F.lit(len(b) - 1)) if which is None else which
        kinds = dict(rows.dtypes)
        x = rows.select(*keep, which.cast("array<int>").alias("which"), *(F.col(c).cast("double").alias(f"_x_{c}") for c in prep.numeric), *(F.col(c).cast("string").alias(f"_c_{c}") for c in prep.categorical))

        def run(batches):
            for batch in batches:
                numbers, cats = _numbers(batch, [f"_x_{c}" for c in prep.numeric]), _categories(batch, [f"_c_{c}" for c in prep.categorical])
                p = np.stack([_sigmoid(prep.matrix(numbers, cats, m) @ b[m]) for m in range(len(b))], axis=1)
                w = batch.column("which")
                offsets, flat = w.offsets.to_numpy() - w.offsets[0].as_py(), w.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                scores = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(p[row, flat]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), w, scores], [*keep, "which", "scores"])

        return x.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", which array<int>, scores array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _violation(g: np.ndarray, b: np.ndarray, l2: float, l1: float) -> float:
    """Greatest miss of the conditions of the optimum; g and b end with the intercept's."""
    slope = g[:-1] + l2 * b[:-1]
    miss = np.where(b[:-1] != 0, np.abs(slope + l1 * np.sign(b[:-1])), np.maximum(np.abs(slope) - l1, 0))
    return float(max(miss.max(initial=0), abs(g[-1])))


def _direction(g: np.ndarray, h: np.ndarray, b: np.ndarray, l2: float, l1: float) -> np.ndarray:
    """Minimum of the quadratic model around b: Newton's step, or coordinate descent where l1 counts."""
    k = len(b)
    ridge = np.append(np.full(k - 1, l2), 0.0)
    h = h + np.diag(ridge + 1e-12 * (1 + np.trace(h) / k))
    slope = g + ridge * b
    if not l1:
        return np.linalg.lstsq(h, -slope, rcond=None)[0]
    d = np.zeros(k)
    for _ in range(1000):
        before = d.copy()
        for j in range(k):
            rest = slope[j] + h[j] @ d - h[j, j] * d[j]
            if j == k - 1:
                d[j] = -rest / h[j, j]
            else:
                z = h[j, j] * b[j] - rest
                d[j] = np.sign(z) * max(abs(z) - l1, 0) / h[j, j] - b[j]
        if np.abs(d - before).max() <= 1e-12 * (1 + np.abs(d).max()):
            break
    return d


def fit(rows: DataFrame, numeric: list[str], categorical: list[str], weights: Column, n_fits: int, kind: Logistic, target: Column | str = "label", least: int = 5, tolerance: float = 1e-8, rounds: int = 60) -> Fits:
    """weights: array of n_fits weights of a row, 0 where it isn't trained on. target: 0 or 1, or an array of n_fits of these."""
    y = F.col(target) if isinstance(target, str) else target
    many = rows.select(y.alias("y")).dtypes[0][1].startswith("array")
    y = y if many else F.array_repeat(y.cast("double"), n_fits)
    work = rows.select(y.cast("array<double>").alias("y"), weights.cast("array<double>").alias("w"), *(F.col(c).cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in categorical)).persist()
    try:
        prep = prepare(work, numeric, categorical, n_fits, least)
        k = len(prep.names()) + 1
        upper = np.triu_indices(k)

        def totals(batch):
            w, t = _lists(batch.column("w"), n_fits), _lists(batch.column("y"), n_fits)
            return np.stack([w.sum(axis=0), (w * t).sum(axis=0)], axis=1)

        found = _summed(work, n_fits, totals)
        n, ones = found.T if found.size else np.zeros((2, n_fits))
        factor = np.ones((n_fits, 2))  # of zeros and ones
        if kind.balance:
            both = (ones > 0) & (n > ones)
            factor[both] = np.stack([n[both] / (2 * (n - ones)[both]), n[both] / (2 * ones[both])], axis=1)
        scale = 1 / np.maximum(n, 1e-300)

        def sums(b):
            def part(batch):
                numbers, cats = _numbers(batch, numeric), _categories(batch, categorical)
                w, t = _lists(batch.column("w"), n_fits), _lists(batch.column("y"), n_fits)
                made = []
                for m in range(n_fits):
                    x = prep.matrix(numbers, cats, m)
                    z = x @ b[m]
                    p, v = _sigmoid(z), w[:, m] * np.where(t[:, m] > 0, factor[m, 1], factor[m, 0]) * scale[m]
                    loss = (v * (np.logaddexp(0, z) - t[:, m] * z)).sum()
                    made.append(np.concatenate([[loss], x.T @ (v * (p - t[:, m])), ((x * (v * p * (1 - p))[:, None]).T @ x)[upper]]))
                return np.array(made)

            got = _summed(work, n_fits, part)
            h = np.zeros((n_fits, k, k))
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = got[:, k + 1 :]
            return got[:, 0], got[:, 1 : k + 1], h

        b, size = np.zeros((n_fits, k)), np.ones(n_fits)
        if not n.any():
            return Fits(prep, b[:, :-1], b[:, -1], np.zeros(n_fits), 0)
        cost = lambda loss, b: loss + kind.l2 / 2 * (b[:, :-1] ** 2).sum(axis=1) + kind.l1 * np.abs(b[:, :-1]).sum(axis=1)
        loss, g, h = sums(b)
        now = cost(loss, b)
        miss = np.array([_violation(g[m], b[m], kind.l2, kind.l1) for m in range(n_fits)])
        steps = 1
        d = np.array([_direction(g[m], h[m], b[m], kind.l2, kind.l1) for m in range(n_fits)])
        while (miss > tolerance).any() and steps < rounds:
            trial = b + size[:, None] * d * (miss > tolerance)[:, None]
            loss, new_g, new_h = sums(trial)
            steps += 1
            new = cost(loss, trial)
            for m in np.flatnonzero(miss > tolerance):
                if new[m] <= now[m] + 1e-14 * (1 + abs(now[m])):
                    b[m], now[m], size[m] = trial[m], new[m], 1.0
                    miss[m] = _violation(new_g[m], b[m], kind.l2, kind.l1)
                    d[m] = _direction(new_g[m], new_h[m], b[m], kind.l2, kind.l1)
                else:
                    size[m] /= 4
                    if size[m] < 1e-8:  # rounding hides what is left to gain
                        size[m] = 0.0
            if not size[miss > tolerance].any():
                break
        if (miss > tolerance).any():
            warnings.warn(f"fit: {int((miss > tolerance).sum())} of {n_fits} fits are off by {miss.max():.2g} after {steps} steps; classes that a column separates have no finite optimum without l2", stacklevel=2)
        return Fits(prep, b[:, :-1], b[:, -1], miss, steps)
    finally:
        work.unpersist()
