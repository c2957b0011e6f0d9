"""Append-only histories of streamed values: when a value began, when another replaced it, when its source fell silent. The state of a key is one small row, and it expires."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, event string, value string, first_seen timestamp, last_seen timestamp, sightings long"


class _History(StatefulProcessor):
    """Keeps a key's value in force with the time of its first and last sighting; a timer a silence after the last sighting drops it."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "value string, first_ms long, last_ms long, sightings long")

    def _row(self, key: Any, event: str, state: tuple) -> pd.DataFrame:
        value, first, last, n = state
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({"key": [key[0]], "event": [event], "value": [value], "first_seen": [at(first)], "last_seen": [at(last)], "sightings": [n]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "value"])
        state = self.current.get() if self.current.exists() else None
        out = []
        for ts, value in zip(seen["ts"], seen["value"], strict=True):
            ms = int(pd.Timestamp(ts).value // 1_000_000)
            if state is not None and value == state[0]:
                # a late sighting may move the start, never the order of values
                state = (value, min(state[1], ms), max(state[2], ms), state[3] + 1)
            elif state is None or ms >= state[2]:
                if state is not None:
                    out.append(self._row(key, "replaced", state))
                state = (value, ms, ms, 1)
                out.append(self._row(key, "began", state))
        if state is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.current.update(state)
            self.handle.registerTimer(state[2] + self.silence_ms)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.current.exists():
            yield self._row(key, "silent", self.current.get())
            self.current.clear()

    def close(self) -> None:
        pass


def value_history(stream: DataFrame, silence: str, late: str = "1 day", key: str = "key", value: str = "value", time: str = "ts") -> DataFrame:
    """A stream of sightings (key, value, time) to its history, rows that are only ever added: ``began`` when a key has a new value, ``replaced`` with the first and last sighting and
    their number when another follows, ``silent`` when none came for ``silence`` of event time, whereupon the key's state is dropped: it holds the keys seen lately, not all ever seen.

    Sightings older than the newest of another value change nothing; those later than the watermark are dropped by Spark. Null values and times are no sightings. State is in
    RocksDB (``spark.sql.streaming.stateStore.providerClass``), so it may outgrow memory; a restart from the checkpoint goes on without repeating rows.
    """
    ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    read = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(time).alias("ts")).where("value is not null and ts is not null")
    return read.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_History(ms), OUTPUT, "Append", "EventTime")
