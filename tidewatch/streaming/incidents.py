"""Incidents of a stream of samples, with state a key and timers of event time.

Samples wait in state, by the hour, until the watermark has passed them; they are then taken in the order of their
time and id, so that late and repeated ones give what the batch form gives over the same rows.  A
timer stands at the earliest sample (or hour) that waits.  The state of a key holds the samples within its
frames and the incident that is open, and survives a restart in the stream's checkpoint.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, opened_at long, closed_at long, repeats long"
#: Waiting samples of an hour are one value; up is -1 where it is unknown.
_SAMPLE = np.dtype([("id", "<i8"), ("at", "<i8"), ("value", "<f8"), ("other", "<f8"), ("up", "i1")])
_STATE = "opened_at long, repeats long, mark double, times array<bigint>, values array<double>, others array<double>"
_NAMES = ["opened_at", "repeats", "mark", "times", "values", "others"]
SECOND = 1_000_000
HOUR = 3600 * SECOND


@dataclass(frozen=True)
class Threshold:
    """Opens when all samples of the last `window` seconds lie above a limit, spanning least_span, and closes when all of calm_window lie below another."""

    above: float
    window: int
    least_span: int
    below: float
    calm_window: int
    calm_span: int

    def fold(self, state: dict, group: list[tuple]) -> Iterator[tuple[int, int | None, int]]:
        """Samples (id, at, value, other, up) of one time, in order; yields what becomes of the incident."""
        group = [g for g in group if g[2] is not None]
        if not group:
            return
        at, times = group[0][1], state["times"]
        times.append(at)
        del times[: bisect_left(times, at - max(self.window, self.calm_window) * SECOND)]
        # values: when a sample was last not above the one limit, and not below the other
        last = state["values"] or [-math.inf, -math.inf]
        breaks = (any(not g[2] > self.above for g in group), any(not g[2] < self.below for g in group))
        state["values"] = last = [float(at) if b else t for b, t in zip(breaks, last)]

        def all_of(window: int, span: int, broken: float) -> bool:
            first = at - window * SECOND
            return broken < first and at - times[bisect_left(times, first)] >= span * SECOND

        high, calm = all_of(self.window, self.least_span, last[0]), all_of(self.calm_window, self.calm_span, last[1])
        for _ in group:
            if calm:
                if state["opened_at"] is not None:
                    yield state["opened_at"], at, state["repeats"]
                state["opened_at"], state["repeats"] = None, 0
            elif high:
                state["opened_at"] = at if state["opened_at"] is None else state["opened_at"]
                state["repeats"] += 1
        if state["opened_at"] is not None:
            yield state["opened_at"], None, state["repeats"]


@dataclass(frozen=True)
class Stall:
    """Opens when the cursor (value) stands where it stood `age` seconds ago while the head (other) advanced and an endpoint is up; closes only when the cursor has moved on."""

    age: int = 900

    def fold(self, state: dict, group: list[tuple]) -> Iterator[tuple[int, int | None, int]]:
        for _, at, cursor, head, up in group:
            if cursor is None:
                continue
            if state["opened_at"] is not None and cursor > state["mark"]:
                yield state["opened_at"], at, state["repeats"]
                state["opened_at"], state["repeats"], state["mark"] = None, 0, None
            if state["values"] and state["values"][-1] != cursor:
                state["times"], state["values"], state["others"] = [], [], []
            state["times"].append(at)
            state["values"].append(cursor)
            state["others"].append(head)
            # the last sample that is old enough stands for all before it
            old = bisect_right(state["times"], at - self.age * SECOND)
            if old:
                for c in ("times", "values", "others"):
                    del state[c][: old - 1]
                base = state["others"][0]
                if up and head is not None and base is not None and head > base:
                    if state["opened_at"] is None:
                        state["opened_at"], state["mark"] = at, cursor
                    state["repeats"] += 1
        if state["opened_at"] is not None:
            yield state["opened_at"], None, state["repeats"]


class Processor(StatefulProcessor):
    """Runs a rule over a key's samples in the order of their time."""

    def __init__(self, rule: Threshold | Stall):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", "rows binary")
        self.own = handle.getValueState("own", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            fresh = np.empty(len(frame), _SAMPLE)
            for c in ("id", "at", "value", "other"):
                fresh[c] = frame[c].astype(_SAMPLE[c])
            fresh["up"] = [-1 if pd.isna(u) else int(u) for u in frame["up"]]
            hours = fresh["at"] // HOUR
            for hour in np.unique(hours).tolist():
                held = self.waiting.getValue((hour,))[0] if self.waiting.containsKey((hour,)) else b""
                self.waiting.updateValue((hour,), (bytes(held) + fresh[hours == hour].tobytes(),))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed, an hour at a time; hours beyond it are not read."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        hours = sorted(int(k[0]) for k in self.waiting.keys())
        ready = [h for h in hours if h * HOUR <= mark]
        wakes = [h * HOUR for h in hours if h * HOUR > mark][:1]
        state = None
        for hour in ready:
            held = np.frombuffer(bytes(self.waiting.getValue((hour,))[0]), _SAMPLE)
            held = held[np.unique(held["id"], return_index=True)[1]]
            held = held[np.lexsort((held["id"], held["at"]))]
            passed = int(np.searchsorted(held["at"], mark, "right"))
            if passed < len(held):
                self.waiting.updateValue((hour,), (held[passed:].tobytes(),))
                wakes = [int(held["at"][passed])]
            else:
                self.waiting.removeKey((hour,))
            if passed:
                state = self._state() if state is None else state
                frame = self._folded(key, state, held[:passed])
                if frame is not None:
                    yield frame
        if state is not None:
            self.own.update(tuple(state[n] for n in _NAMES))
        for at in wakes:
            self.handle.registerTimer(at // 1000 + 1)

    def _state(self) -> dict:
        state = dict(zip(_NAMES, self.own.get() or ())) if self.own.exists() else {}
        state = {n: state.get(n) for n in _NAMES} | {n: list(state[n]) if state.get(n) is not None else [] for n in _NAMES[3:]}
        return state | {"repeats": int(state["repeats"] or 0)}

    def _folded(self, key, state: dict, held: np.ndarray) -> pd.DataFrame | None:
        """What becomes of each incident by these samples: its last change, and its close if there is one."""
        # a value that is not a number is unknown
        known = lambda c: [None if math.isnan(v) else v for v in held[c].tolist()]
        rows = zip(held["id"].tolist(), held["at"].tolist(), known("value"), known("other"), [None if u < 0 else bool(u) for u in held["up"].tolist()])
        out: dict[int, tuple] = {}
        for _, group in groupby(rows, key=lambda r: r[1]):
            for opened, closed, repeats in self.rule.fold(state, list(group)):
                out[opened] = (opened, closed, repeats)
        if not out:
            return None
        frame = pd.DataFrame([(key[0], *x) for x in out.values()], columns=["key", "opened_at", "closed_at", "repeats"])
        return frame.astype({"opened_at": "Int64", "closed_at": "Int64", "repeats": "Int64"})

    def close(self) -> None:
        pass


def incident_stream(samples: DataFrame, rule: Threshold | Stall, delay: str) -> DataFrame:
    """Changes (key, opened_at, closed_at, repeats) of incidents; times in microseconds.

    samples: a stream of (key, id, ts, value), for Stall also other and up.  A sample may be late by
    delay and come any number of times; ids are unique in a key.  The stream's session needs RocksDB's
    state store (with_state_store()).
    """
    rows = samples
    for name, kind in (("other", "double"), ("up", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("key", "id", "ts", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"), F.col("other").cast("double").alias("other"), "up")
    return rows.groupBy("key").transformWithStateInPandas(Processor(rule), OUT, "Append", "EventTime")


def newest(changes: DataFrame) -> DataFrame:
    """One row an incident of its changes: repeats only grow, and a close is final."""
    return changes.groupBy("key", "opened_at").agg(F.max("closed_at").alias("closed_at"), F.max("repeats").alias("repeats"))


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
