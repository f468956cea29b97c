"""Event-time joins. Inputs have a column with the time in ms and share no column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import common, some
from ..functions.windows import first_start, floor_to, shared_starts
from .queryset import is_words


def named(df: DataFrame, prefix: str) -> DataFrame:
    """All columns with a prefix."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _masks(df: DataFrame, masks: tuple[str, str] | None) -> Column:
    """Whether the rows have a query in common; df has the first mask."""
    return F.lit(True) if masks is None else some(common(*masks, is_words(df, masks[0])), is_words(df, masks[0]))


def _merge(df: DataFrame, masks: tuple[str, str] | None) -> DataFrame:
    """The pair's queries are those that both rows belong to."""
    return df if masks is None else df.withColumn("qmask", common(*masks, is_words(df, masks[0]))).drop(*(m for m in masks if m != "qmask"))


#: Windows a row from which pairs of a three-way join stay spans until both joins are done: fewer cost less as rows.
SPANS = 8


def near_in_time(one: DataFrame, two: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], reach: int, within: Column, masks=None, buckets=(-1, 0, 1), step: int | None = None) -> DataFrame:
    """Equi-join on keys and `within`, which must imply that times differ by `reach` at most: by buckets of that length.
    With buckets of `step`, a longer one, the right row is only copied into those that it reaches: one, mostly.

    The left row stays in its bucket, the right one is copied into three (or into `buckets` that hold all partners), so the join is an equi-join on (key, bucket):
    it shuffles, sorts and splits skewed keys like any other, and each pair comes once.
    """
    copies = F.sequence(floor_to(F.col(times[1]) - reach, step), floor_to(F.col(times[1]) + reach, step), F.lit(step)) if step else F.array(*[floor_to(times[1], max(reach, 1)) + d * max(reach, 1) for d in buckets])
    left = one.withColumn("bucket", floor_to(times[0], step or max(reach, 1)))
    right = two.withColumn("bucket_", F.explode(copies))
    on = (F.col("bucket") == F.col("bucket_")) & within & _masks(one, masks)
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return _merge(left.join(right, on).drop("bucket", "bucket_"), masks)


def window_join(one: DataFrame, two: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], size: int, slide: int, masks=None) -> DataFrame:
    """Pairs that share a window, once each, with the first and the last window that they share.

    Tumbling windows join on (key, window). Sliding ones pair rows less than a size apart and count the shared windows
    by arithmetic, instead of copying each row into size / slide windows before the join.
    """
    first, last = shared_starts(*times, size, slide)
    if size == slide:
        on = (floor_to(times[0], size) == floor_to(times[1], size)) & _masks(one, masks)
        for a, b in keys:
            on = on & (F.col(a) == F.col(b))
        pairs = _merge(one.join(two, on), masks)
    else:
        apart = F.abs(F.col(times[0]) - F.col(times[1]))
        pairs = near_in_time(one, two, keys, times, size, (apart < size) & (first <= last), masks)
    return pairs.withColumn("first_window", first).withColumn("last_window", last)


def in_each_window(pairs: DataFrame, slide: int, name: str = "window_start") -> DataFrame:
    """A row for each window that a pair shares."""
    return pairs.withColumn(name, F.explode(F.sequence("first_window", "last_window", F.lit(slide)))).drop("first_window", "last_window")


def shared_windows(slide: int) -> Column:
    """How many windows a pair shares."""
    return (F.col("last_window") - F.col("first_window")) / slide + 1


def interval_join(one: DataFrame, two: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], reach: int, masks=None) -> DataFrame:
    """Pairs whose times differ by `reach` at most, once each."""
    return near_in_time(one, two, keys, times, reach, F.abs(F.col(times[0]) - F.col(times[1])) <= reach, masks)


def three_way(one: DataFrame, two: DataFrame, three: DataFrame, first: tuple[str, str], second: tuple[str, str], times: tuple[str, str, str], size: int, slide: int, masks=None) -> DataFrame:
    """(one with two) with three, all in windows of one kind; a pair's time is the end of its window. Rows per window.

    `masks` names the masks of all three; each step keeps the queries that all its inputs belong to.
    """
    pairs = window_join(one, two, [first], times[:2], size, slide, masks and masks[:2])
    on, both = [second], masks and ("qmask", masks[2])
    if size < SPANS * slide:
        pairs = in_each_window(pairs, slide, "pair_window").withColumn("pair_ms", F.col("pair_window") + (size - 1)).drop("pair_window")
        return in_each_window(window_join(pairs, three, on, ("pair_ms", times[2]), size, slide, both), slide)
    # a pair stays one row through the second join: its windows' ends lie in windows from its first to `until`, of which
    # the third row has some. Only then come the windows of the pair, and those that each of their ends shares.
    reach = (size - 1) // slide * slide
    until, low, high = F.col("last_window") + reach, first_start(times[2], size, slide), floor_to(times[2], slide)
    meets = (low <= until) & (high >= F.col("first_window"))
    # the third row's time is that of the pair's first window at least, and less than three sizes later
    pairs = near_in_time(pairs.withColumn("pair_start", F.col("first_window")), three, on, ("pair_start", times[2]), size, meets, both, buckets=(-3, -2, -1, 0))
    pairs = pairs.withColumn("pair_window", F.explode(F.sequence("first_window", "last_window", F.lit(slide)))).drop("first_window", "last_window", "pair_start")
    w = F.col("pair_window")
    pairs = pairs.withColumn("pair_ms", w + (size - 1)).withColumn("first_window", F.greatest(w, low)).withColumn("last_window", F.least(w + reach, high))
    return in_each_window(pairs.filter("first_window <= last_window").drop("pair_window"), slide)


#: Rows of both sides that a task joins, sorted in memory: beyond TASKS up to eight times as many, as Spark writes a
#: shuffle to more than 200 tasks by sorting it, which takes a writing task more memory than that.
ROWS, TASKS = 1 << 19, 200


def winning_bids(auctions: DataFrame, bids: DataFrame, rows: int = 0) -> DataFrame:
    """auctions(id, seller, category, reserve, ms, expires_ms, sell_below_reserve), bids(auction, bidder, price, ms).

    Per auction the price of its highest bid before it expires, if it reaches the reserve or the seller sells below it:
    equal bids have the same. The maximum is kept in a hash table, not sorted. `rows`, how many both have together, sets
    the number of tasks, so that a task's memory stays within bounds.
    """
    a, b = auctions.drop("ms"), bids.select("auction", "price", F.col("ms").alias("bid_ms"))
    spark = a.sparkSession
    if rows > ROWS * min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        n = max(min(-(-rows // ROWS), TASKS), -(-rows // (8 * ROWS)))
        a, b = a.repartition(n, "id"), b.repartition(n, "auction")
    open_ = b.join(a, (F.col("auction") == F.col("id")) & (F.col("bid_ms") < F.col("expires_ms")))
    won = open_.groupBy("id", "seller", "category", "reserve", "expires_ms", "sell_below_reserve").agg(F.max("price").alias("price"))
    return won.filter((F.col("price") >= F.col("reserve")) | F.col("sell_below_reserve")).select(F.col("id").alias("auction"), "price", "category", "seller", "expires_ms")


def lookup(df: DataFrame, dimension: DataFrame, key: tuple[str, str]) -> DataFrame:
    """Left join with a dimension table; Spark broadcasts it if it is small enough. A streaming df stays streaming."""
    return df.join(dimension, df[key[0]] == dimension[key[1]], "left").drop(dimension[key[1]])
