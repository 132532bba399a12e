"""Scans over live readings, with state for each asset: the causal parts of the batch operators, row by row in event time.

Readings may come out of order by as much as the watermark allows. A reading waits until the watermark has passed it, so
what comes out is in order, and equal to the batch operators over the same readings. State is bounded: the last readings
of a window, the open run, and what waits. A timer wakes an asset whose readings wait, though no new one comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import require_positive

#: Microseconds of readings that wait, their values, the last values, the open run's rows, and the last microsecond that is done.
STATE = "times array<long>, waiting array<double>, ring array<double>, run long, done long"


def _scanned(ring: np.ndarray, x: np.ndarray, run: int, rows: int, limit: int, threshold: float, least: int) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """(columns for x, the new ring, the new run) of readings that follow the ring; NaN is missing."""
    whole = pd.Series(np.concatenate([ring, x]))
    smoothed = whole.rolling(rows, 1).mean().to_numpy()[len(ring) :]
    carried = (whole.ffill(limit=limit) if limit else whole).to_numpy()[len(ring) :]
    above = x > threshold
    # A run's length at each row: rows since the last one that isn't above, and the open run before the first such.
    at = np.arange(1, len(x) + 1)
    last = np.maximum.accumulate(np.where(above, 0, at))
    length = np.where(above, at - last + np.where(last == 0, run, 0), 0)
    columns = {"smoothed": smoothed, "filled": carried, "run": length, "alarm": length == least}
    return columns, whole.to_numpy()[-max(rows, limit) :], int(length[-1])


def live_scan(
    readings: DataFrame, key: str = "asset_id", time: str = "ts", value: str = "x", horizon_hours: float = 6.0, timestep_hours: float = 1 / 6, limit: int = 2, threshold: float = 0.5, least: int = 1, late: str = "30 minutes",
) -> DataFrame:
    """key, time, value, smoothed, filled, run, alarm for each reading, when the watermark has passed it.

    smoothed is the mean of the last round(horizon / timestep) readings, filled carries a value over at most limit missing
    ones, run counts readings above the threshold without a break, and alarm tells where a run has become `least` long:
    an episode's start. A reading that comes later than `late` is dropped, as is one without a time. Of readings at one
    time the lesser value is first, missing ones last.
    """
    rows = max(int(round(horizon_hours / timestep_hours)), 1)
    for name, v in (("least", least), ("rows", rows)):
        require_positive(v, name)
    source = readings.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value")).filter("time is not null")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting, ring, run, done = state.get if state.exists else ([], [], [], 0, -(2**62))
        t, x = [np.array(times, np.int64)], [np.array([np.nan if v is None else v for v in waiting], float)]
        for f in frames:
            t.append(f["time"].to_numpy().astype("datetime64[us]").astype(np.int64))
            x.append(f["value"].to_numpy(float))
        t, x = np.concatenate(t), np.concatenate(x)
        passed = state.getCurrentWatermarkMs() * 1000
        t, x = t[t > done], x[t > done]
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        ready = int(np.searchsorted(t, passed, "right"))
        ring = np.array([np.nan if v is None else v for v in ring], float)
        if ready:
            columns, ring, run = _scanned(ring, x[:ready], run, rows, limit, threshold, least)
            done = int(t[ready - 1])
            yield pd.DataFrame({"key": group[0], "time": pd.to_datetime(t[:ready], unit="us"), "value": x[:ready], **columns})
        state.update((t[ready:].tolist(), x[ready:].tolist(), ring.tolist(), run, done))
        if ready < len(t):
            state.setTimeoutTimestamp(int(max(t[ready] // 1000, passed // 1000)) + 1)

    found = source.withWatermark("time", late).groupBy("key").applyInPandasWithState(
        step, "key string, time timestamp, value double, smoothed double, filled double, run long, alarm boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    missing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(F.col("key").alias(key), F.col("time").alias(time), missing("value").alias(value), missing("smoothed"), missing("filled"), "run", "alarm")


def replayed(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream gives until its source has no more, as a table; a checkpoint that is there is gone on from."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
