"""Streaming counterparts of the causal operators; an extension, for live readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_levels(readings: DataFrame, time: str = "ts", key: str = "asset_id", value: str = "x", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean and number of readings in tumbling windows, for each asset; readings later than `late` are dropped."""
    windowed = readings.withWatermark(time, late).groupBy(F.window(time, width), key)
    return windowed.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def live_sliding(readings: DataFrame, time: str = "ts", key: str = "asset_id", value: str = "x", width: str = "6 hours", slide: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """A trailing mean over event time, at each slide; the batch operator counts rows instead."""
    return live_levels_of(readings.withWatermark(time, late).groupBy(F.window(time, width, slide), key), key, value)


def live_levels_of(grouped, key: str, value: str) -> DataFrame:
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.col("window.end").alias("end"), "mean", "n")


def live_sessions(alarms: DataFrame, time: str = "ts", key: str = "asset_id", gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Alarms of an asset that follow each other within the gap, as one episode."""
    grouped = alarms.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return grouped.agg(F.count("*").alias("alarms")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "alarms")
