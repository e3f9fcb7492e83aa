"""Panels: cut grids on the odometer, labels, rows of windows, sequences and stacks. Window features are in panes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .panes import CHANNELS
from .panes import channels as bin_channels


def cut_grid(trips: DataFrame, events: DataFrame, window_km: float, gap_km: float, horizon_km: float, step_km: float, censored: str = "drop") -> DataFrame:
    """One row per vehicle and cut: multiples of step_km from a full window after the least end odometer on.

    Cuts of a vehicle with an event end gap_km before it; label is 1 if the event falls in [c + gap, c + gap + horizon]. Cuts of the
    others end where that follow-up ends, or, with censored = 'keep', with the history.
    """
    ends = trips.groupBy("vehicle_id").agg(F.min("odo_end").alias("first_odo"), F.max("odo_end").alias("last_odo")).join(events, "vehicle_id", "left")
    end = F.coalesce(F.col("event_odo") - gap_km, F.col("last_odo") - (gap_km + horizon_km if censored == "drop" else 0.0))
    lo, hi = F.ceil((F.col("first_odo") + window_km) / step_km), F.floor((end + 1e-6) / step_km)
    cut = F.col("c") * F.lit(step_km)
    left = F.col("event_odo") - cut
    return ends.filter(lo <= hi).withColumn("c", F.explode(F.sequence(lo, hi))).select(
        "vehicle_id", cut.alias("cut_odo"), "event_odo", "last_odo", F.col("event_odo").isNotNull().cast("int").alias("event_observed"),
        F.coalesce(left <= gap_km + horizon_km, F.lit(False)).cast("int").alias("label"), left.alias("time_to_event_km"), (F.col("last_odo") - cut).alias("km_after"))


def serve_cuts(rows: DataFrame, window_km: float, step_km: float, at: str = "odo_end") -> DataFrame:
    """Each row once for every cut c with c - window < at <= c: an explode in place of a range join."""
    lo, hi = F.ceil(F.col(at) / step_km), F.ceil((F.col(at) + window_km) / step_km) - 1
    return rows.filter(F.col(at).isNotNull()).withColumn("cut_odo", F.explode(F.transform(F.sequence(lo, hi), lambda c: c * F.lit(step_km))))


def window_rows(rows: DataFrame, cuts: DataFrame, window_km: float, step_km: float, at: str = "odo_end") -> DataFrame:
    """Rows joined to the cuts whose window (c - window, c] holds them. The join is an equi-join on vehicle and cut."""
    cols = [c for c in cuts.columns if c not in rows.columns or c in ("vehicle_id", "cut_odo")]
    return serve_cuts(rows, window_km, step_km, at).join(cuts.select(*cols), ["vehicle_id", "cut_odo"])


def days_covered() -> Column:
    """Days from the first start to the last end, 1 at least; for a grouping of trips."""
    return F.greatest((F.max(F.unix_micros("t_end")) - F.min(F.unix_micros("t_start"))) / 86_400e6, F.lit(1.0))


def with_prev_event(rows: DataFrame, event: Column) -> DataFrame:
    """prev_pos: odometer of the vehicle's previous row with the event (by odometer, then event_id)."""
    by = Window.partitionBy("vehicle_id").orderBy("odo_end", "t_start", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prev_pos", F.last(F.when(event, F.col("odo_end")), ignorenulls=True).over(by))


def bins(rows: DataFrame, bin_km: float, aggs: list[Column], at: str = "odo_end") -> DataFrame:
    """Aggregates per vehicle and bin ceil(odo / bin) - 1; bin 0 also takes odometer 0."""
    return rows.withColumn("bin", F.greatest(F.ceil(F.col(at) / bin_km) - 1, F.lit(0))).groupBy("vehicle_id", "bin").agg(*aggs)


#: Fills by name: (channel, rows of the sequence up to the step, rows from the step on) -> Column.
FILLS: dict[str, Callable[[Column, WindowSpec, WindowSpec], Column]] = {
    "none": lambda x, past, rest: x,
    "zero": lambda x, past, rest: F.coalesce(x, F.lit(0.0)),
    "carry": lambda x, past, rest: F.coalesce(F.last(x, ignorenulls=True).over(past), F.first(x, ignorenulls=True).over(rest)),
    "carry_zero": lambda x, past, rest: F.coalesce(F.last(x, ignorenulls=True).over(past), F.first(x, ignorenulls=True).over(rest), F.lit(0.0)),
}
#: Transforms of a filled channel by name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"log1p": F.log1p, "sqrt": F.sqrt}


@dataclass(frozen=True)
class Channel:
    """A declared channel of a sequence: what is aggregated in a bin and how, what an empty bin holds, and a last transform."""

    name: str
    x: str
    agg: str
    fill: str = "zero"
    transform: str | None = None

    def __post_init__(self):
        for value, known, kind in ((self.agg, CHANNELS, "aggregator"), (self.fill, FILLS, "fill"), (self.transform, TRANSFORMS, "transform")):
            if value is not None and value not in known:
                raise ValueError(f"channel {self.name}: {kind} {value} is not known; known are {sorted(known)}")


def sequences(binned: DataFrame, cuts: DataFrame, channels: list[str | Channel], window_km: float, bin_km: float) -> DataFrame:
    """Long form of the T x C tensor: a row per cut and bin t of its window. Channels given by name are carried forward, then back, then 0."""
    channels = [Channel(c, c, "mean", "carry_zero") if isinstance(c, str) else c for c in channels]
    t_len = int(window_km / bin_km)
    spine = cuts.select("vehicle_id", "cut_odo").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(t_len - 1)))).withColumn("bin", (F.col("cut_odo") / bin_km - t_len + F.col("t")).cast("long"))
    x = spine.join(binned, ["vehicle_id", "bin"], "left")
    past = Window.partitionBy("vehicle_id", "cut_odo").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("vehicle_id", "cut_odo").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    filled = [FILLS[c.fill](F.col(c.name), past, rest).alias(c.name) for c in channels]
    x = x.select("vehicle_id", "cut_odo", "t", *filled, F.col(channels[0].name).isNotNull().alias("seen"))
    return x.withColumns({c.name: TRANSFORMS[c.transform](F.col(c.name)) for c in channels if c.transform})


def declared_sequences(rows: DataFrame, cuts: DataFrame, channels: list[Channel], window_km: float, bin_km: float) -> DataFrame:
    """sequences of declared channels, from rows."""
    return sequences(bin_channels(rows, bin_km, [(c.name, c.x, c.agg) for c in channels]), cuts, channels, window_km, bin_km)


def flatten(seq: DataFrame, channels: list[str]) -> DataFrame:
    """One row per cut: feat_seq as an array over t of structs of the channels."""
    x = seq.groupBy("vehicle_id", "cut_odo").agg(F.array_sort(F.collect_list(F.struct("t", *channels))).alias("s"), F.avg(F.col("seen").cast("double")).alias("coverage"))
    return x.select("vehicle_id", "cut_odo", "coverage", F.transform("s", lambda e: F.struct(*(e[c].alias(c) for c in channels))).alias("feat_seq"))


def stack_periods(rows: DataFrame, entry: str, duration: str, event: str, bin_km: float, upper_km: float) -> DataFrame:
    """Person-period rows with late entry: a row per bin at risk, hazard 1 in the event's bin. What lasts beyond upper_km is censored there."""
    n = int(upper_km / bin_km)
    first, last = F.floor(F.col(entry) / bin_km), F.least(F.floor(F.col(duration) / bin_km), F.lit(n - 1))
    x = rows.filter((F.col(entry) < upper_km) & (first <= last)).withColumn("bin", F.explode(F.sequence(first, last)))
    return x.withColumn("hazard", ((F.col(event) == 1) & (F.col("bin") == F.least(F.floor(F.col(duration) / bin_km), F.lit(n - 1))) & (F.col(duration) <= upper_km)).cast("int"))


def stack_exposure(rows: DataFrame, entry: str, exit_: str, event: str, bin_size: float, upper: float) -> DataFrame:
    """Piecewise-exponential rows: exposure and event in each bin that [entry, exit] touches."""
    a, b = F.greatest(F.col(entry), F.lit(0.0)), F.least(F.col(exit_), F.lit(upper))
    x = rows.filter(a < b).withColumn("bin", F.explode(F.sequence(F.floor(a / bin_size), F.ceil(b / bin_size) - 1)))
    lo, hi = F.col("bin") * F.lit(bin_size), (F.col("bin") + 1) * F.lit(bin_size)
    return x.withColumns({"exposure": F.least(b, hi) - F.greatest(a, lo), "hazard": ((F.col(event) == 1) & (F.col(exit_) > lo) & (F.col(exit_) <= hi) & (F.col(exit_) <= upper)).cast("int")})
