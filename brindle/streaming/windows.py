"""Event-time windows over streams. Timestamps without a zone are read as the session's zone, since
watermarks need an instant; results carry them without a zone again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """With a watermark: rows later than `late` may be dropped, and state older than it is."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def _plain(counted: DataFrame, *more: str) -> DataFrame:
    bounds = [F.col(f"window.{b}").cast("timestamp_ntz").alias(f"window_{b}") for b in ("start", "end")]
    return counted.select(*bounds, *more)


def tumbling(stream: DataFrame, size: str, *measures: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return sliding(stream, size, size, *measures, by=by)


def sliding(stream: DataFrame, size: str, step: str, *measures: Column, by: tuple[str, ...] = ()) -> DataFrame:
    measures = measures or (F.count("*").alias("n"),)
    counted = stream.groupBy(F.window("ts", size, step).alias("window"), *by).agg(*measures)
    return _plain(counted, *by, *(c for c in counted.columns if c not in ("window", *by)))


def sessions(stream: DataFrame, gap: str, by: tuple[str, ...], *measures: Column) -> DataFrame:
    """A session of a key ends once nothing came for `gap`."""
    measures = measures or (F.count("*").alias("n"),)
    counted = stream.groupBy(F.session_window("ts", gap).alias("window"), *by).agg(*measures)
    return _plain(counted, *by, *(c for c in counted.columns if c not in ("window", *by)))


def first_only(stream: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def shown(windows: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """With the bounds of windows as text."""
    bounds = {c: F.date_format(c, pattern) for c in ("window_start", "window_end") if c in windows.columns}
    return windows.withColumns(bounds)
