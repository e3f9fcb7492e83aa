"""Streams: daily activity with a watermark, and first sustained alerts with state by vehicle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "run int, start double, lead double, done boolean"
ALERT = "vehicle_id long, alert_odo double, lead_km double"


def daily_activity(trips: DataFrame, late: str = "2 days") -> DataFrame:
    """Trips, km and vehicles (approximate) by day; a day is final once the watermark has passed it."""
    d = F.window("t_start", "1 day")
    return trips.withWatermark("t_start", late).groupBy(d).agg(F.count("*").alias("n_trips"), F.sum("trip_km").alias("km"), F.approx_count_distinct("vehicle_id").alias("n_vehicles")).select(F.to_date("window.start").alias("day"), "n_trips", "km", "n_vehicles")


def first_alerts(scores: DataFrame, tau: float, k: int) -> DataFrame:
    """First of k consecutive cuts with scores >= tau, once a vehicle. A vehicle's cuts must come in order of cut_odo over the batches.

    State of a vehicle: how long its run is, where it began, and whether it has alerted; it doesn't grow.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, start, lead, done = state.get if state.exists else (0, 0.0, 0.0, False)
        rows = pd.concat(list(frames)).sort_values("cut_odo")
        out = []
        for at, s, t in zip(rows["cut_odo"], rows["score"], rows["time_to_event_km"]):
            if done:
                break
            if s >= tau:
                if run == 0:
                    start, lead = float(at), float("nan") if pd.isna(t) else float(t)
                run += 1
            else:
                run = 0
            if run == k:
                done = True
                out.append((int(key[0]), start, None if pd.isna(lead) else lead))
        state.update((run, start, lead, done))
        yield pd.DataFrame(out, columns=["vehicle_id", "alert_odo", "lead_km"])

    x = scores.select("vehicle_id", "cut_odo", "score", "time_to_event_km")
    return x.groupBy("vehicle_id").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.NoTimeout)


class _Ordered(StatefulProcessor):
    """Cuts of a vehicle wait by odometer until the watermark has passed their time; runs advance over those it has passed."""

    def __init__(self, tau: float, k: int):
        self.tau, self.k = tau, k

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cut_odo double", "at long, score double, lead double")
        self.run = handle.getValueState("run", "n int, start double, lead double, upto double, done boolean, wake long")

    def _state(self):
        return tuple(self.run.get()) if self.run.exists() else (0, 0.0, None, float("-inf"), False, None)

    def _wake(self, at_us: int, old: int | None) -> int:
        """One timer a vehicle, at the first whole millisecond at or after a time; each call to state is a round trip, so an equal one stays."""
        ms = -(-at_us // 1000)
        if ms != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
        return ms

    def _waiting(self) -> dict[float, tuple]:
        return {k[0]: tuple(v) for k, v in self.waiting.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, start, lead, upto, done, wake = self._state()
        if done:
            return
        held = self._waiting()
        new: dict[float, tuple] = {}
        for frame in rows:
            for odo, at, score, ahead in zip(frame["cut_odo"], frame["at"], frame["score"], frame["time_to_event_km"]):
                x = (int(at), float("-inf") if pd.isna(score) else float(score), None if pd.isna(ahead) else float(ahead))
                old = new.get(odo, held.get(odo))
                if odo > upto and (old is None or x[:2] > old[:2]):
                    new[float(odo)] = x
        for odo, x in new.items():
            self.waiting.updateValue((odo,), x)
        if new:
            self.run.update((n, start, lead, upto, done, self._wake(min(x[0] for x in (held | new).values()), wake)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        n, start, lead, upto, done, _ = self._state()
        held = self._waiting()
        for odo in sorted(held):
            at, score, ahead = held[odo]
            if at > passed or done:
                break
            if score >= self.tau:
                start, lead = (odo, ahead) if n == 0 else (start, lead)
                n += 1
            else:
                n = 0
            upto, done = odo, n == self.k
        gone = [odo for odo in held if odo <= upto or done]
        if len(gone) == len(held):
            self.waiting.clear()
        else:
            for odo in gone:
                self.waiting.removeKey((odo,))
        left = [x[0] for odo, x in held.items() if odo > upto and not done]
        self.run.update((n, start, lead, upto, done, self._wake(max(min(left), passed + 1000), None) if left else None))
        yield pd.DataFrame([(int(key[0]), start, lead)] if done else [], columns=["vehicle_id", "alert_odo", "lead_km"])


def ordered_alerts(scores: DataFrame, tau: float, k: int, late: str = "2 days") -> DataFrame:
    """First of k consecutive cuts with scores >= tau, once a vehicle, for cuts that come in any order, repeated, and up to late behind the latest scored_at.

    A vehicle's cuts wait by odometer until the watermark has passed their time, so the alerts are those of the batch operator over all cuts that
    it has passed. A cut that waits behind one of less odometer and later time waits on; of repeats of a cut that waits, the one with the latest time
    counts (then the greatest score); cuts behind the watermark, or at or below an odometer already passed, are dropped. Rows without vehicle, odometer or time are left out; a null score
    is below tau. State: a vehicle's cuts of the time that late allows, and its run; after its alert only that it has alerted. State is kept in RocksDB, which this session is set to.
    """
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    x = scores.select("vehicle_id", "cut_odo", "score", "time_to_event_km", "scored_at").filter("vehicle_id is not null and cut_odo is not null and scored_at is not null")
    x = x.withWatermark("scored_at", late).withColumn("at", F.unix_micros("scored_at"))
    return x.groupBy("vehicle_id").transformWithStateInPandas(_Ordered(tau, k), ALERT, "append", "EventTime")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet below path, with its checkpoint beside it, and read the result."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
