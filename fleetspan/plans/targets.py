"""Targets, decoders and reporters by name, resolved when a run is declared.

A target turns panel columns into what a model learns, a decoder turns a model's output into a score and extra columns, a reporter sums predictions
up. All are functions of Columns or DataFrames in a dictionary; add to it to extend.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import risk

#: name -> (**params) -> columns by part.
TARGETS: dict[str, Callable[..., dict[str, Column]]] = {
    "survival": risk.survival_target,
    "cure": risk.cure_target,
    "ordinal": lambda edges: {"class": risk.ordinal_target(tuple(edges))},
    "far_soft": lambda horizon_km, far_km: {"soft": risk.soft_label(horizon_km, far_km)},
    "label": lambda: {"label": F.col("label")},
}


@dataclass(frozen=True)
class Target:
    """A declared target: its name, its parameters, and the columns (part: column's name) that are wanted; without any, all parts by their own names."""

    name: str
    params: dict = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)

    def parts(self) -> dict[str, Column]:
        made = _known(TARGETS, "target", self.name)(**self.params)
        missing = set(self.columns) - set(made)
        if missing:
            raise KeyError(f"target {self.name} has no {sorted(missing)}; it has {sorted(made)}")
        return {to: made[part] for part, to in self.columns.items()} or made


def _known(registry: dict, kind: str, name: str):
    if name not in registry:
        raise KeyError(f"{kind} {name} is not known; known are {sorted(registry)}")
    return registry[name]


def with_targets(rows: DataFrame, declared: list[Target]) -> DataFrame:
    """rows and the columns of the declared targets; fails if two give the same column."""
    made: dict[str, Column] = {}
    for t in declared:
        for name, column in t.parts().items():
            if name in made:
                raise ValueError(f"two targets give {name}")
            made[name] = column
    return rows.withColumns(made)


def _ordinal(p: Column, classes: int, at_least: int = 1) -> dict[str, Column]:
    beyond = lambda k: F.aggregate(F.slice(p, k + 1, classes - k), F.lit(0.0), lambda a, b: a + b)
    return {"score": beyond(at_least), **{f"p_at_least_{k}": beyond(k) for k in range(1, classes)}}


#: name -> (column of the model's output, **params) -> score and extra columns.
DECODERS: dict[str, Callable[..., dict[str, Column]]] = {
    "binary": lambda p: {"score": p[1]},
    "ordinal": _ordinal,
    "hazards": lambda h: {"score": 1 - F.exp(F.aggregate(h, F.lit(0.0), lambda a, b: a + F.log1p(-F.least(b, F.lit(1 - 1e-12)))))},
}


def decode(rows: DataFrame, name: str, output: str, **params) -> DataFrame:
    """rows with score and the decoder's extra columns. output: array column of the model's output."""
    made = _known(DECODERS, "decoder", name)(F.col(output), **params)
    if "score" not in made:
        raise ValueError(f"decoder {name} gives no score")
    return rows.withColumns(made)


def _binary_report(rows: DataFrame, label: str = "label") -> DataFrame:
    y = F.col(label).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg("score").alias("mean_score"), F.avg(F.pow(F.col("score") - y, 2)).alias("brier"))


def _class_report(rows: DataFrame, label: str = "class") -> DataFrame:
    """Per class: rows, share, share from vehicles with an event, mean score."""
    g = rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col("event_observed").cast("double")).alias("event_share"), F.avg("score").alias("mean_score"))
    total = rows.agg(F.count("*").alias("_n"))
    return g.crossJoin(total).select(label, "n", (F.col("n") / F.col("_n")).alias("share"), "event_share", "mean_score")  # one row


#: name -> (predictions with score, **params) -> report.
REPORTERS: dict[str, Callable[..., DataFrame]] = {"binary": _binary_report, "ordinal": _class_report}


def report(rows: DataFrame, name: str, **params) -> DataFrame:
    return _known(REPORTERS, "reporter", name)(rows, **params)
