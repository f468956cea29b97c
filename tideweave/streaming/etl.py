"""The JSON pipeline on streams: parsing and lookup are the batch functions; sums go by watermarked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import avro_pair_hex
from .windows import aggregate


def serialised_sums_stream(df: DataFrame, ts: str, size: str, slide: str | None, key: str, value: str) -> DataFrame:
    """df with a watermark on `ts` to (window_start, key, total, payload), as soon as a window closes."""
    sums = aggregate(df.withColumnRenamed(key, "key"), ["key"], {"total": F.sum(value)}, ts, size, slide)
    return sums.select("window_start", "key", "total", avro_pair_hex(F.col("key"), F.col("total")).alias("payload"))
