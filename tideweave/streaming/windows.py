"""Windowed joins and aggregates on streams with watermarks, by built-in operators; the same functions take tables.

State holds each row once per window that it is in, until the watermark passes the window's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import floor_to
from ..operators.aggregates import array_median, array_top_mean


def window_of(ts, size: str, slide: str | None = None) -> Column:
    return F.window(ts, size, slide or size)


def window_pairs(one: DataFrame, two: DataFrame, keys: tuple[str, str], times: tuple[str, str], size: str, slide: str | None = None, masks: tuple[str, str] | None = None) -> DataFrame:
    """Inner join per window and key: a row for each window that a pair shares, with its `window`."""
    a = one.withColumn("window", window_of(times[0], size, slide))
    b = two.withColumn("window_", window_of(times[1], size, slide))
    on = (F.col("window") == F.col("window_")) & (F.col(keys[0]) == F.col(keys[1]))
    if masks:
        on = on & (F.col(masks[0]).bitwiseAND(F.col(masks[1])) != 0)
    out = a.join(b, on).drop("window_")
    return out.withColumn("qmask", F.col(masks[0]).bitwiseAND(F.col(masks[1]))).drop(*masks) if masks else out


def interval_pairs(one: DataFrame, two: DataFrame, keys: tuple[str, str], times: tuple[str, str], reach: str, masks: tuple[str, str] | None = None) -> DataFrame:
    """Pairs at most `reach` apart, once each; rows leave the state when the watermark is that far past them."""
    gap = F.expr(f"interval {reach}")
    on = (F.col(keys[0]) == F.col(keys[1])) & (F.col(times[1]) >= F.col(times[0]) - gap) & (F.col(times[1]) <= F.col(times[0]) + gap)
    if masks:
        on = on & (F.col(masks[0]).bitwiseAND(F.col(masks[1])) != 0)
    out = one.join(two, on)
    return out.withColumn("qmask", F.col(masks[0]).bitwiseAND(F.col(masks[1]))).drop(*masks) if masks else out


def aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, Column], ts: str | None = None, size: str | None = None, slide: str | None = None) -> DataFrame:
    """Per window and key. With `ts` rows get windows of their own; else the `window` of a join is used."""
    window = window_of(ts, size, slide) if ts else F.col("window")
    out = df.groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.withColumn("window_start", F.unix_millis("window.start")).drop("window")


def rewindowed(df: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Results of a window as rows of later windows, at the time of their window's end."""
    return df.withColumn("window", F.window(F.window_time("window"), size, slide or size))


def median(value: str, columns: list[str]) -> Column:
    return array_median(value, columns)


def top_mean(value: str, n: int = 10) -> Column:
    return array_top_mean(value, n)


def reporting(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows and lag behind the clock per interval, for a stream with an `emitted` timestamp."""
    late = F.current_timestamp().cast("double") - F.col("emitted").cast("double")
    return df.groupBy(F.window(ts, interval)).agg(F.count("*").alias("n"), F.max(late).alias("lag_s"))


__all__ = ["aggregate", "floor_to", "interval_pairs", "median", "reporting", "rewindowed", "top_mean", "window_of", "window_pairs"]
