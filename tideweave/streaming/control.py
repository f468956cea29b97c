"""Queries that are switched on and off by a stream of their own."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.masks import queries_in, words_in
from ..operators.queryset import is_words

#: Milliseconds of rows that wait in one entry of the state.
SLICE = 3_600_000


class Switched(StatefulProcessor):
    """One query's rows and switches. A row waits until the watermark has passed it, so that every switch up to its time
    is known, whichever stream was read first; it goes on if the last switch at its time or before was on."""

    def __init__(self, slice_ms: int):
        self.slice = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.switches = handle.getValueState("switches", "ms array<bigint>, active array<boolean>")
        self.waiting = handle.getMapState("waiting", "slice bigint", "ms array<bigint>, body array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            control = batch[batch["body"].isna()]
            if len(control):
                known = list(zip(*self.switches.get(), strict=True)) if self.switches.exists() else []
                # of switches at one time the last in order of off and on holds, so on
                known = sorted({*known, *((int(t), bool(a)) for t, a in zip(control["ms"], control["active"], strict=True))})
                self.switches.update(([t for t, _ in known], [a for _, a in known]))
            data = batch[batch["body"].notna()]
            for part_at, part in data.groupby(data["ms"] // self.slice, sort=True):
                at = (int(part_at),)
                ms, body = ([], []) if not self.waiting.containsKey(at) else map(list, self.waiting.getValue(at))
                if not ms:
                    self.handle.registerTimer((at[0] + 1) * self.slice)
                self.waiting.updateValue(at, (ms + [int(t) for t in part["ms"]], body + part["body"].tolist()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() // self.slice - 1,)
        if not self.waiting.containsKey(at):
            return
        ms, body = map(list, self.waiting.getValue(at))
        self.waiting.removeKey(at)
        if not self.switches.exists():
            return
        times, active = map(list, self.switches.get())
        on = [i for i, t in enumerate(ms) if (k := bisect_right(times, t)) and active[k - 1]]
        # a switch that a later one has replaced before all waiting rows isn't asked again
        past = bisect_right(times, at[0] * self.slice) - 1
        if past > 0:
            self.switches.update((times[past:], active[past:]))
        if on:
            yield pd.DataFrame({"qid": key[0], "body": [body[i] for i in on], "ts": pd.to_datetime([ms[i] for i in on], unit="ms")})

    def close(self) -> None:
        pass


def active_stream(df: DataFrame, control: DataFrame, n: int, ts: str = "ts", mask: str = "qmask", salts: int = 16, slice_ms: int = SLICE) -> DataFrame:
    """df with a query set below n, and control(qid, ts, active), both streams with watermarks, to (qid, row, ts): a row for
    each query of a row's set that is switched on at the row's time; a query without a switch so far is off.

    A switch holds from its time on, inclusive. Rows come out once the watermark has passed their slice of time. A query's
    rows are dealt to `salts` keys, each of which gets all its switches: a query that takes all rows is `salts` tasks.
    """
    queries = (words_in if is_words(df, mask) else queries_in)(mask, n)
    rows = df.select(F.col(ts).alias("ts"), F.explode(queries).alias("qid"), F.unix_millis(ts).alias("ms"), F.to_json(F.struct(*df.columns)).alias("body"))
    rows = rows.select("ts", "qid", F.pmod(F.xxhash64("body"), F.lit(salts)).cast("int").alias("salt"), "ms", "body", F.lit(None).cast("boolean").alias("active"))
    switches = control.select(F.col("ts"), F.col("qid").cast("int").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.unix_millis("ts").alias("ms"), F.lit(None).cast("string").alias("body"), "active")
    both = rows.unionByName(switches)
    got = both.groupBy("qid", "salt").transformWithStateInPandas(Switched(slice_ms), "qid int, body string, ts timestamp", "Append", "EventTime")
    return got.select("qid", F.from_json("body", df.schema).alias("row"), "ts")
