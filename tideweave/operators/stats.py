"""Selectivities, match counts and load figures as data jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import unit
from ..functions.windows import floor_to
from .factorised import band_matches


def range_of(attr: str, ranges: list[tuple[int, int]]) -> Column:
    """Number of the first range that holds the attribute, or null."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(ranges))):
        out = F.when(F.col(attr).between(lo, hi), F.lit(i)).otherwise(out)
    return out


def selectivity(df: DataFrame, ranges: list[tuple[int, int]], attr: str = "filter_attr") -> DataFrame:
    """(range, lo, hi, selected, total) in one pass; ranges without rows have 0."""
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(range_of(attr, ranges) == i, 1)).alias(f"n{i}") for i in range(len(ranges))])
    each = F.array(*[F.struct(F.lit(i).alias("range"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"), F.col(f"n{i}").alias("selected")) for i, (lo, hi) in enumerate(ranges)])
    return counted.select("total", F.explode(each).alias("x")).select("x.*", "total")


def earliest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows: a sample that doesn't depend on partitions. n is a bound of the caller's."""
    return df.orderBy(*order).limit(n)


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group: Spark keeps k rows a group in each task before the shuffle, and k after it."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place_", F.row_number().over(place)).filter(F.col("place_") <= k).drop("place_")


def match_matrix(one: DataFrame, two: DataFrame, keys: tuple[str, str], times: tuple[str, str], reach: int, attrs: tuple[str, str], ranges: list[tuple[int, int]]) -> DataFrame:
    """(low, high, matches): joined pairs per unordered pair of ranges, counted by a sweep over each key's times."""
    r1, names = range_of(attrs[0], ranges), [f"m{i}" for i in range(len(ranges))]
    a = one.filter(r1.isNotNull()).select(F.col(keys[0]).alias("key"), F.col(times[0]).alias("at"), *[(r1 == i).cast("bigint").alias(c) for i, c in enumerate(names)])
    b = two.select(F.col(keys[1]).alias("key"), F.col(times[1]).alias("at"), range_of(attrs[1], ranges).alias("r2")).filter("r2 is not null")
    got = band_matches(a, b, ["key"], "at", reach, names, ["r2"])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("r1"), F.col(f"n_{c}").alias("n")) for i, c in enumerate(names)])).alias("x")
    pairs = got.select("r2", each).filter("x.n > 0")
    return pairs.groupBy(F.least("x.r1", "r2").alias("low"), F.greatest("x.r1", "r2").alias("high")).agg(F.sum("x.n").alias("matches"))


def latency(df: DataFrame, ms: str, emitted: str, interval: int, order: list[str]) -> DataFrame:
    """(interval_ms, sample, mean, worst): time from emission to event time in ms; the sample is the interval's first row."""
    late = F.col(ms) - F.col(emitted)
    return df.groupBy(floor_to(ms, interval).alias("interval_ms")).agg(F.min_by(late, F.struct(*order)).alias("sample"), F.avg(late).alias("mean"), F.max(late).alias("worst"))


def latency_percentiles(df: DataFrame, ms: str, emitted: str, interval: int) -> DataFrame:
    """(interval_ms, p50, p95, p99) of the time from emission to event time, exact: different values of an interval are
    counted before the shuffle, but meet in one task. latency_sketches have a fixed size instead."""
    late = (F.col(ms) - F.col(emitted)).alias("late")
    counted = df.groupBy(floor_to(ms, interval).alias("interval_ms"), late).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("interval_ms").agg(*[F.percentile("late", p / 100, F.col("n")).alias(f"p{p}") for p in (50, 95, 99)])


#: Size of a sketch, and how far, as a share of the rows, a quantile's rank may be off (for this size, 99 % of the time,
#: the published bound is 0.0133 for one quantile).
SKETCH, RANK_ERROR = 200, 0.0133


def latency_sketches(df: DataFrame, ms: str, emitted: str, interval: int) -> DataFrame:
    """(interval_ms, sketch): a quantile sketch of each interval, about 2 KB whatever its rows. Sketches merge, before the
    shuffle and after it, and of intervals to longer ones; on a stream they are the state of a window."""
    late = (F.col(ms) - F.col(emitted)).cast("bigint")
    return df.groupBy(floor_to(ms, interval).alias("interval_ms")).agg(F.kll_sketch_agg_bigint(late, SKETCH).alias("sketch"))


def merged(sketches: DataFrame, interval: int) -> DataFrame:
    """Sketches of short intervals to those of longer ones."""
    return sketches.groupBy(floor_to("interval_ms", interval).alias("interval_ms")).agg(F.kll_merge_agg_bigint("sketch", SKETCH).alias("sketch"))


def sketched(sketches: DataFrame) -> DataFrame:
    """(interval_ms, p50, p95, p99) of sketches."""
    return sketches.select("interval_ms", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])


def throughput(telemetry: DataFrame) -> DataFrame:
    """telemetry(subtask, interval_ms, produced, consumed) with running sums and the backlog."""
    so_far = Window.partitionBy("subtask").orderBy("interval_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return telemetry.withColumn("consumed_total", F.sum("consumed").over(so_far)).withColumn("backlog", F.sum(F.col("produced") - F.col("consumed")).over(so_far))


def smoothed(telemetry: DataFrame, span: int = 12, seconds: int = 60) -> DataFrame:
    """(interval_ms, throughput): consumed in the last `span` intervals over `seconds`, summed over subtasks."""
    order = Window.partitionBy("subtask").orderBy("interval_ms")
    rate = F.expr(f"cast((consumed_total - was) div {seconds} as bigint)")
    rows = throughput(telemetry).withColumn("was", F.lag("consumed_total", span, 0).over(order))
    return rows.groupBy("interval_ms").agg(F.sum(rate).alias("throughput"))


def shed(df: DataFrame, rates: DataFrame, ms: str, step: int, id_: str, desired: int, subtasks: int, seed: int = 7) -> DataFrame:
    """Rows that survive shedding: rates(interval_ms, rate, backlog) per interval; a backlog beyond desired / subtasks
    drops the row, one below minus that keeps it, else it goes with probability `rate`, by a hash of its id."""
    share = desired // subtasks
    rows = df.withColumn("interval_ms", floor_to(ms, step)).join(rates, "interval_ms", "left")
    goes = F.when(F.col("backlog") > share, True).when(F.col("backlog") < -share, False).otherwise(unit(seed, "shed", F.col(id_)) < F.coalesce("rate", F.lit(0.0)))
    return rows.filter(~goes).drop("interval_ms", "rate", "backlog")


def shedding_rates(telemetry: DataFrame, desired: DataFrame, warm_up: int = 4, weight: float = 0.5, discount: float = 0.1, growth: float = 3.0) -> DataFrame:
    """(subtask, interval_ms, rate): per subtask a fold over its intervals in order.

    telemetry(subtask, interval_ms, throughput, backlog), desired(interval_ms, desired). When the desired throughput
    changes, the rate becomes what keeps the sustainable one. After `warm_up` measurements the rate moves halfway to the
    missing share; while there is no backlog that is discounted, more each time. A subtask has one short row per interval.
    """
    steps = telemetry.join(desired, "interval_ms").groupBy("subtask").agg(F.array_sort(F.collect_list(F.struct("interval_ms", F.col("throughput").cast("double").alias("throughput"), "backlog", F.col("desired").cast("double").alias("desired")))).alias("steps"))
    zero = F.struct(F.lit(0.0).alias("rate"), F.lit(discount).alias("discount"), F.lit(None).cast("double").alias("desired"), F.lit(0).alias("seen"), F.array().cast("array<struct<interval_ms:bigint,rate:double>>").alias("out"))

    def fold(acc, x):
        changed = acc["desired"].isNotNull() & (acc["desired"] != x["desired"])
        sustainable = F.when(acc["rate"] == 0, x["desired"]).otherwise(acc["desired"] * (1 - acc["rate"]))
        held = F.when(changed, F.least(F.lit(1.0), 1 - sustainable / x["desired"])).otherwise(acc["rate"])
        missing = F.least(F.lit(1.0), 1 - x["throughput"] / x["desired"])
        free = x["backlog"] <= 0
        target = F.when(free, missing * (1 - acc["discount"])).otherwise(missing)
        warm = acc["seen"] >= warm_up
        rate = F.when(warm, F.least(F.lit(1.0), (1 - weight) * held + weight * target)).otherwise(held)
        next_ = F.when(~warm, acc["discount"]).when(~free, F.lit(discount)).when(target != 0, F.least(F.lit(1.0), acc["discount"] * growth)).otherwise(acc["discount"])
        return F.struct(rate.alias("rate"), next_.alias("discount"), x["desired"].alias("desired"), (acc["seen"] + 1).alias("seen"), F.concat(acc["out"], F.array(F.struct(x["interval_ms"].alias("interval_ms"), rate.alias("rate")))).alias("out"))

    return steps.select("subtask", F.explode(F.aggregate("steps", zero, fold)["out"]).alias("x")).select("subtask", "x.*")
