"""Signals as streams: causal filters that keep their state, windows, and intervals as sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import filters

SAMPLE = "recording string, channel string, sample long, value double"


def causal_filter(stream: DataFrame, low: float | None, high: float | None, sfreq: float, order: int = 4) -> DataFrame:
    """A causal Butterworth filter over a stream of samples (recording, channel, sample, value).

    The filter's state and the next sample's number are kept for each channel. Samples of a batch are put in order; a
    sample at or before the last one filtered came too late for the state and is dropped, and a gap is filtered over as if
    it weren't there. So a batch job and a stream give the same values where samples arrive in order.
    """
    sos = filters.butterworth(low, high, sfreq, order)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, *kept = state.get if state.exists else (-1, [0.0] * (2 * len(sos)))
        values = np.array(kept[0], float)
        rows = pd.concat(list(frames)).sort_values("sample").drop_duplicates("sample")
        rows = rows[rows["sample"] > last]
        if len(rows):
            y, values = filters.causal(sos, rows.value.to_numpy(float), values)
            state.update((int(rows["sample"].iloc[-1]), values.tolist()))
            yield rows.assign(value=y)[["recording", "channel", "sample", "value"]]

    named = stream.select(F.col("recording").cast("string").alias("recording"), "channel", "sample", "value")
    return named.groupBy("recording", "channel").applyInPandasWithState(run, SAMPLE, "last long, values array<double>", "append", "NoTimeout")


#: What filter_events() gives: a filtered sample; how many rows of a batch came too late (value); or the end of a channel, with its last sample and how many came too late in all.
EVENTS = "recording string, channel string, event string, sample long, value double"
_STATE = "last long, values array<double>, late long"


class _Filter(StatefulProcessor):
    """The state of a channel's filter, of the late rows and of the timer that ends it."""

    def __init__(self, sos: np.ndarray, idle: int | None):
        self.sos, self.idle = sos, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("filter", _STATE)

    def _row(self, key, event: str, sample, value) -> pd.DataFrame:
        return pd.DataFrame({"recording": [key[0]], "channel": [key[1]], "event": [event], "sample": pd.array([sample], "Int64"), "value": [float(value)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, values, late = self.state.get() if self.state.exists() else (-1, [0.0] * (2 * len(self.sos)), 0)
        table = pd.concat(list(rows)).sort_values("sample")
        fresh = table[table["sample"] > last].drop_duplicates("sample")
        missed = int((table["sample"] <= last).sum())
        if len(fresh):
            y, values = filters.causal(self.sos, fresh.value.to_numpy(float), np.array(values, float))
            last, values = int(fresh["sample"].iloc[-1]), values.tolist()
            yield pd.DataFrame({"recording": key[0], "channel": key[1], "event": "sample", "sample": fresh["sample"].astype("Int64"), "value": y})
        self.state.update((last, list(values), late + missed))
        if missed:
            yield self._row(key, "late", None, missed)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, late = self.state.get()
        self.state.clear()
        yield self._row(key, "end", last, late)

    def close(self) -> None:
        pass


def filter_events(stream: DataFrame, low: float | None, high: float | None, sfreq: float, idle_seconds: float | None = None, order: int = 4) -> DataFrame:
    """causal_filter() with typed state: rows of EVENTS. Late rows are counted instead of passed over, and with ``idle_seconds`` a channel from which nothing
    came for so long ends: its state goes, and what comes later begins anew. Timers make a batch follow every batch, so such a stream runs until it
    is stopped. State is kept in RocksDB, which this session then uses for streams."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = stream.select(F.col("recording").cast("string").alias("recording"), "channel", "sample", "value")
    made = _Filter(filters.butterworth(low, high, sfreq, order), None if idle_seconds is None else int(1000 * idle_seconds))
    return named.groupBy("recording", "channel").transformWithStateInPandas(made, T.StructType.fromDDL(EVENTS), "append", "None" if idle_seconds is None else "ProcessingTime")


def windowed_table(stream: DataFrame, time: str, length: str, late: str, step: str | None = None) -> DataFrame:
    """Count, mean, population standard deviation and range of each channel in windows of event time; rows later than ``late`` are dropped."""
    window = F.window(time, length, step) if step else F.window(time, length)
    v = F.col("value")
    grouped = stream.withWatermark(time, late).groupBy(window.alias("w"), "recording", "channel")
    table = grouped.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("ptp"))
    return table.select("recording", "channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "ptp")


def sessions(stream: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """Events of a recording and description less than ``gap`` apart put together: (recording, description, start, end, n)."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), "recording", "description")
    return grouped.agg(F.count("*").alias("n")).select("recording", "description", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
