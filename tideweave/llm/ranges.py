"""Places in a global order, found by ranges: no task holds more than its range, whatever the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """df in `order` (nulls first) over ranges, written: with `part`, the range's number, and `row`, the place in it."""
    keys = [c.asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(parts or parts_of(df), *keys).sortWithinPartitions(*keys)
    return cut(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the global order, from 0. One short row per range is summed in one task."""
    rows = placed(df, order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_"))
    starts = counted.select(F.col("part").alias("part_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return rows.join(starts, F.col("part") == F.col("part_")).withColumn(name, F.col("start_") + F.col("row")).drop("part", "row", "part_", "start_")
