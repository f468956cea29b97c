"""Per-key state for streams, where no built-in operator keeps it. State is read and written once per key and batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Stands for no value yet.
LEAST = -(2**63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State stores that keep more keys than fit in memory; transformWithState needs one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class RisingMax(StatefulProcessor):
    """Emits the rows whose value exceeds every earlier one of their key, or all rows with the maximum so far."""

    def __init__(self, every: bool = False, ttl_ms: int | None = None):
        self.every, self.ttl_ms = every, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "value bigint", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState["value"].dropna()
        if len(known):
            self.peak.update((int(known.max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = int(self.peak.get()[0]) if self.peak.exists() else LEAST
        batch = pd.concat([b for b in rows if len(b)], ignore_index=True).sort_values(["ms", "id"])
        if batch.empty:
            return
        whole = batch["value"].astype("Int64").fillna(LEAST).to_numpy(np.int64)
        peak = np.maximum.accumulate(np.concatenate([[start], whole]))
        if self.every:
            yield batch.assign(key=key[0], value=np.maximum(peak[1:], 0))[["key", "id", "ms", "value"]]
        else:
            yield batch.assign(key=key[0], value=whole)[["key", "id", "ms", "value"]][peak[1:] > peak[:-1]]
        if peak[-1] > start:
            self.peak.update((int(peak[-1]),))

    def close(self) -> None:
        pass


def _peaks(initial: DataFrame | None, key: str, value: str):
    """Greatest values of a batch as the state that a stream begins with."""
    return None if initial is None else initial.select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("value")).groupBy("key")


def rising_stream(df: DataFrame, key: str, value: str, every: bool = False, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """df(key, id, ms, value) to (key, id, ms, value): the streaming form of `rising` and, with `every`, `running_peak`.

    Within a batch rows come in the order of (ms, id). State has a number per key, for ever unless `ttl_ms` is set. It
    begins with the values of `initial`(key, value), so a stream goes on where a batch has ended. The least bigint counts
    as no value.
    """
    rows = df.select(F.col(key).alias("key"), "id", "ms", F.col(value).cast("bigint").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(RisingMax(every, ttl_ms), "key bigint, id bigint, ms bigint, value bigint", "Append", "None", _peaks(initial, key, value))


class WinningBid(StatefulProcessor):
    """One auction and its bids: keeps the auction, the best bid, and bids that came before it; closes at expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", "category bigint, seller bigint, reserve bigint, expires_ms bigint, below boolean")
        self.best = handle.getValueState("best", "price bigint, ms bigint, bidder bigint")
        self.early = handle.getListState("early", "price bigint, ms bigint, bidder bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        r = initialState
        if r.expires_ms is not None:
            self.auction.update((r.category, r.seller, r.reserve, r.expires_ms, r.below))
            self.handle.registerTimer(r.expires_ms)
        if r.price is not None:
            best = (r.price, r.bid_ms, r.bidder)
            if r.expires_ms is not None:
                self.best.update(best)
            else:
                self.early.appendValue(best)
                self.handle.registerTimer(r.bid_ms + self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bids, fresh = [], None
        for r in rows:
            if r.kind == "auction":
                fresh = (r.category, r.seller, r.reserve, r.expires_ms, r.below)
            else:
                bids.append((r.price, r.ms, r.bidder))
        if fresh is not None and not self.auction.exists():
            self.auction.update(fresh)
            self.handle.registerTimer(fresh[3])
            if self.early.exists():
                bids += [tuple(b) for b in self.early.get()]
                self.early.clear()
        if not self.auction.exists():
            if bids:
                self.early.appendList(bids)
                # bids whose auction never comes don't stay for ever
                self.handle.registerTimer(max(b[1] for b in bids) + self.patience_ms)
            return
        expires = self.auction.get()[3]
        if self.best.exists():
            bids.append(tuple(self.best.get()))
        bids = [b for b in bids if b[1] < expires]
        if bids:
            self.best.update(max(bids, key=lambda b: (b[0], -b[1], -b[2])))
        return
        yield

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.auction.exists():
            late = [tuple(b) for b in self.early.get()] if self.early.exists() else []
            if not any(b[1] + self.patience_ms > at for b in late):
                self.early.clear()
            return
        category, seller, reserve, expires, below = self.auction.get()
        if at < expires:
            return
        if self.best.exists():
            price = self.best.get()[0]
            if price >= reserve or below:
                yield Row(auction=key[0], price=price, category=category, seller=seller, expires_ms=expires)
        self.auction.clear()
        self.best.clear()

    def close(self) -> None:
        pass


def auction_state(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Auctions and bids of a batch as the state that winning_bids_stream begins with: per auction its terms and its best bid
    before it expires, and, of bids that came before their auction, each."""
    b = bids.select(F.col("auction").alias("of"), "price", F.col("ms").alias("bid_ms"), "bidder")
    terms = auctions.select(F.col("id").alias("auction"), "category", "seller", "reserve", "expires_ms", F.col("sell_below_reserve").alias("below"))
    best = F.max(F.when(F.col("bid_ms") < F.col("expires_ms"), F.struct("price", (-F.col("bid_ms")).alias("early"), (-F.col("bidder")).alias("low")))).alias("best")
    known = terms.join(b, F.col("auction") == F.col("of"), "left").groupBy(*terms.columns).agg(best)
    known = known.select(*terms.columns, F.col("best.price").alias("price"), (-F.col("best.early")).alias("bid_ms"), (-F.col("best.low")).alias("bidder"))
    ahead = b.join(terms.select("auction"), F.col("of") == F.col("auction"), "left_anti").select(F.col("of").alias("auction"), *[F.lit(None).cast(t).alias(c) for c, t in terms.dtypes[1:]], "price", "bid_ms", "bidder")
    return known.unionByName(ahead)


def winning_bids_stream(auctions: DataFrame, bids: DataFrame, delay: str = "0 seconds", patience_ms: int = 10 * 365 * 86_400_000, initial: DataFrame | None = None) -> DataFrame:
    """auctions(id, seller, category, reserve, ts, expires_ms, sell_below_reserve) and bids(auction, bidder, price, ts) to
    the rows of `winning_bids`, each as soon as event time passes the auction's expiry. Late rows are dropped. `initial` is
    an auction_state of what a batch has seen before."""
    ms = F.unix_millis("ts")
    none = lambda kind: F.lit(None).cast(kind)
    a = auctions.select(F.lit("auction").alias("kind"), F.col("id").alias("auction"), "ts", "category", "seller", "reserve", "expires_ms", F.col("sell_below_reserve").alias("below"), none("bigint").alias("price"), none("bigint").alias("bidder"))
    b = bids.select(F.lit("bid").alias("kind"), "auction", "ts", none("bigint").alias("category"), none("bigint").alias("seller"), none("bigint").alias("reserve"), none("bigint").alias("expires_ms"), none("boolean").alias("below"), "price", "bidder")
    both = a.unionByName(b).withWatermark("ts", delay).withColumn("ms", ms)
    return both.groupBy("auction").transformWithState(WinningBid(patience_ms), "auction bigint, price bigint, category bigint, seller bigint, expires_ms bigint", "Append", "EventTime", None if initial is None else initial.groupBy("auction"))


class WindowRecord(StatefulProcessor):
    """Window maxima in; those above every earlier one and 0 out, in window order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "value bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState["value"].dropna()
        if len(known):
            self.peak.update((int(known.max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = int(self.peak.get()[0]) if self.peak.exists() else 0
        batch = pd.concat([b for b in rows if len(b)], ignore_index=True).dropna(subset=["value"]).sort_values("window_start")
        if batch.empty:
            return
        value = batch["value"].astype("int64").to_numpy()
        peak = np.maximum.accumulate(np.concatenate([[max(start, 0)], value]))
        yield batch.assign(key=key[0], value=value)[["key", "window_start", "value", "qmask"]][peak[1:] > peak[:-1]]
        if peak[-1] > start:
            self.peak.update((int(peak[-1]),))

    def close(self) -> None:
        pass


def window_records_stream(df: DataFrame, size: str, key: str, value: str, mask: str = "qmask", initial: DataFrame | None = None) -> DataFrame:
    """df(key, id, ts, value, mask), with a watermark, to (key, window_start, value, qmask): the streaming `window_records`.
    `initial`(key, value) has the greatest values before; the stream begins with a window of its own."""
    best = F.max(F.struct(F.col(value).cast("bigint").alias("v"), (-F.unix_millis("ts")).alias("t"), (-F.col("id")).alias("i"), F.col(mask).alias("q"))).alias("best")
    high = df.groupBy(F.window("ts", size), F.col(key).alias("key")).agg(best)
    rows = high.select("key", F.unix_millis("window.start").alias("window_start"), F.col("best.v").alias("value"), F.col("best.q").alias("qmask"))
    return rows.groupBy("key").transformWithStateInPandas(WindowRecord(), "key bigint, window_start bigint, value bigint, qmask bigint", "Append", "None", _peaks(initial, key, value))
