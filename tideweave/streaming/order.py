"""Order statistics of windows on streams, whose state follows the different values, or the n highest, not the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def median_stream(df: DataFrame, keys: list[str], value: str, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """df with a watermark on `ts` to (window_start, keys, median, n): the upper median of a key's values as its window closes.

    A first aggregate counts rows by value, so state has a number per window, key and different value. The counts of a
    window that closes go to a second one, in which running sums over the sorted values find the middle.
    """
    counts = df.groupBy(F.window(ts, size, slide or size).alias("window"), *keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values")
    rows = counts.filter("value is not null").groupBy("window", *keys).agg(sorted_, F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast(dict(counts.dtypes)["value"]).alias("median"))
    half = F.floor(F.col("total") / 2) + 1

    def step(acc, x):
        upto = acc["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.when((acc["upto"] < half) & (upto >= half), x["value"]).otherwise(acc["median"]).alias("median"))

    middle = F.aggregate("values", start, step)["median"]
    return rows.select(F.unix_millis("window.start").alias("window_start"), *keys, middle.alias("median"), F.col("total").alias("n"))


class Top(StatefulProcessor):
    """The n highest values of each window of a key; a timer at the window's end gives their mean."""

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "window_start bigint", "best array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for window, part in batch.groupby("window_start", sort=True):
                at = (int(window),)
                held: list[float] = []
                if self.best.containsKey(at):
                    held = list(self.best.getValue(at)[0])
                else:
                    self.handle.registerTimer(at[0] + self.size)
                self.best.updateValue(at, (sorted([*held, *part["value"].nlargest(self.n).tolist()], reverse=True)[: self.n],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() - self.size,)
        if self.best.containsKey(at):
            best = list(self.best.getValue(at)[0])
            self.best.removeKey(at)
            if best:
                yield pd.DataFrame({"key": [key[0]], "window_start": [at[0]], "mean": [sum(best) / len(best)], "n": [len(best)]})

    def close(self) -> None:
        pass


def top_mean_stream(df: DataFrame, key: str, value: str, ts: str, size: int, slide: int, n: int = 10) -> DataFrame:
    """df with a watermark on `ts` to (key, window_start, mean, n): the mean of each window's n highest values as it
    closes; size and slide in ms. State has n numbers per key and window at most."""
    from ..functions.windows import starts

    rows = df.filter(F.col(value).isNotNull()).select(F.col(ts).alias("ts"), F.col(key).cast("bigint").alias("key"), F.col(value).cast("double").alias("value"), F.explode(starts(F.unix_millis(ts), size, slide)).alias("window_start"))
    return rows.groupBy("key").transformWithStateInPandas(Top(size, n), "key bigint, window_start bigint, mean double, n bigint", "Append", "EventTime")
