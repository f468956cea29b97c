"""Window joins on streams that hold each row once, whatever the number of windows it is in.

Both sides are one stream by key. A key's state has a list of rows per side and bucket of a window's size; a row meets the
rows of the other side in its own and both neighbouring buckets, and a pair is a span of windows, as in the batch join. An
event-time timer drops a bucket as soon as no later row can share a window with it. Results carry their event time, so
joins can be chained and aggregated behind one another in one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key bigint, one string, two string, first_window bigint, last_window bigint, ts timestamp"


class WindowPairs(StatefulProcessor):
    def __init__(self, size: int, slide: int, each: bool):
        self.size, self.slide, self.each = size, slide, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "side int, bucket bigint", "ms array<bigint>, body array<string>")

    def _held(self, side: int, bucket: int):
        if not self.rows.containsKey((side, bucket)):
            return np.zeros(0, np.int64), []
        ms, body = self.rows.getValue((side, bucket))
        return np.asarray(ms, np.int64), list(body)

    def _pairs(self, key, side: int, ms, body, other_ms, other_body) -> pd.DataFrame | None:
        if not len(ms) or not len(other_ms):
            return None
        order = np.argsort(other_ms, kind="stable")
        at = other_ms[order]
        low, high = np.searchsorted(at, ms - self.size, "right"), np.searchsorted(at, ms + self.size, "left")
        n = high - low
        mine = np.repeat(np.arange(len(ms)), n)
        theirs = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        x, y = ms[mine], other_ms[theirs]
        first = (np.maximum(x, y) - self.size) // self.slide * self.slide + self.slide
        last = np.minimum(x, y) // self.slide * self.slide
        keep = np.flatnonzero(first <= last)
        if self.each:
            n = (last[keep] - first[keep]) // self.slide + 1
            keep = np.repeat(keep, n)
            first = first[keep] + self.slide * (np.arange(len(keep)) - np.repeat(np.cumsum(n) - n, n))
            last = first
        else:
            first, last = first[keep], last[keep]
        one, two = (mine, theirs) if side == 0 else (theirs, mine)
        bodies = (body, other_body) if side == 0 else (other_body, body)
        return pd.DataFrame({
            "key": key, "one": [bodies[0][i] for i in one[keep]], "two": [bodies[1][i] for i in two[keep]],
            "first_window": first, "last_window": last, "ts": pd.to_datetime(last + self.size - 1, unit="ms"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.assign(bucket=batch["ms"] // self.size)
            for (side, bucket), part in batch.groupby(["side", "bucket"], sort=True):
                side, bucket, ms, body = int(side), int(bucket), part["ms"].to_numpy(np.int64), part["body"].tolist()
                for near in (bucket - 1, bucket, bucket + 1):
                    got = self._pairs(key[0], side, ms, body, *self._held(1 - side, near))
                    if got is not None and len(got):
                        yield got
                held, bodies = self._held(side, bucket)
                if not len(held):
                    # rows of this bucket come before (bucket + 1) * size, and partners of theirs within another size
                    self.handle.registerTimer((bucket + 2) * self.size)
                self.rows.updateValue((side, bucket), ([*held.tolist(), *ms.tolist()], bodies + body))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.size - 2
        for side in (0, 1):
            if self.rows.containsKey((side, bucket)):
                self.rows.removeKey((side, bucket))
        return iter(())

    def close(self) -> None:
        pass


def window_pairs_once(one: DataFrame, two: DataFrame, keys: tuple[str, str], times: tuple[str, str], size: int, slide: int, each: bool = False) -> DataFrame:
    """Streams with watermarks on their times to (key, one, two, first_window, last_window, ts): pairs that share a
    window, once each, as soon as both rows are there; with `each` a row for each window that they share.

    `one` and `two` are structs of the inputs' columns, with times to the millisecond. ts, the event time, is the last
    millisecond of the pair's last window, so results may be joined or aggregated by windows of it in the same query. Keys
    are whole numbers; null keys and times join nothing; rows behind the watermark are dropped.
    """
    part = lambda df, side, k, t: df.filter(F.col(k).isNotNull()).select(F.col(t).alias("ts"), F.col(k).cast("bigint").alias("key"), F.lit(side).alias("side"), F.unix_millis(t).alias("ms"), F.to_json(F.struct(*df.columns)).alias("body"))
    both = part(one, 0, keys[0], times[0]).unionByName(part(two, 1, keys[1], times[1]))
    pairs = both.groupBy("key").transformWithStateInPandas(WindowPairs(size, slide, each), OUT, "Append", "EventTime", eventTimeColumnName="ts")
    read = lambda c, df: F.from_json(c, df.schema).alias(c)
    return pairs.select("key", read("one", one), read("two", two), "first_window", "last_window", "ts")


def three_way_once(one: DataFrame, two: DataFrame, three: DataFrame, first: tuple[str, str], second: tuple[str, str], times: tuple[str, str, str], size: int, slide: int) -> DataFrame:
    """(one with two) with three in windows of one kind, a pair's time being the end of its window, as in the batch join:
    (one, two, three, pair_ms, window_start, ts), a row per window. Inputs share no column names; the second join's
    watermark is that of the first one's results and of `three`, whichever is behind."""
    pairs = window_pairs_once(one, two, first, times[:2], size, slide, each=True)
    ends = pairs.select("one", "two", F.col(f"two.{second[0]}").alias("pair_key"), F.unix_millis("ts").alias("pair_ms"), F.col("ts").alias("pair_ts"))
    got = window_pairs_once(ends, three, ("pair_key", second[1]), ("pair_ts", times[2]), size, slide, each=True)
    return got.select("one.one", "one.two", F.col("two").alias("three"), "one.pair_ms", F.col("first_window").alias("window_start"), "ts")
