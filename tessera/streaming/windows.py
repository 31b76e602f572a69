"""Event-time windows that work on streams and on tables alike.

On a stream a watermark bounds the state: rows later than ``late`` behind the
newest one are dropped, and a window's result is final after that. On a table
nothing is late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def windowed(df: DataFrame, time: str, size: str, keys: list[str], aggregates: dict[str, Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, stop, keys, aggregates) of tumbling windows, or of sliding ones with ``slide``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = _marked(df, time, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """(start, stop, keys, aggregates) of runs of rows no further apart than ``gap``; a session ends a gap after its last row."""
    rows = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, *aggregates)


def first_seen(df: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once; on a stream a key may come again after the watermark has passed it."""
    return _marked(df, time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
