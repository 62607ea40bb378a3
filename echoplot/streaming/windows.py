"""Measures of unbounded channels by event time, with the same expressions as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, keys: list[str], measures: dict[str, Column], size: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """keys, start, stop and the measures of each event-time window. On a stream, a window ends once the
    watermark has passed it and rows later than `late` no longer count; on a batch all rows count.
    State is one partial aggregate a key and open window."""
    at = F.window(time, size, step) if step else F.window(time, size)
    source = df.withWatermark(time, late) if df.isStreaming else df
    out = source.groupBy(*keys, at.alias("w")).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *measures)


def channel_measures(value: str) -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "n_missing": F.count_if(F.col(value).isNull()), "mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value)}
