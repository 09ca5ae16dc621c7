"""Event-time sugar over streams and tables: extensions that the keyed model itself doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """ts as a timestamp with the session's zone; watermarks refuse those without one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _grouped(df: DataFrame, ts: str, window: Column, keys: list[str], aggs: dict[str, Column], late: str | None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    found = rows.groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggs)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    return _grouped(event_time(df, ts), ts, F.window(ts, size), keys, aggs, late)


def sliding(df: DataFrame, ts: str, size: str, step: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    return _grouped(event_time(df, ts), ts, F.window(ts, size, step), keys, aggs, late)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: dict[str, Column], late: str | None = None) -> DataFrame:
    return _grouped(event_time(df, ts), ts, F.session_window(ts, gap), keys, aggs, late)
