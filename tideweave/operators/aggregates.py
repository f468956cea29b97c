"""Keyed aggregates over windows and over all time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import holds
from ..functions.windows import DAY, floor_to, paned
from .queryset import is_words, per_query


def _same(columns: list[str]) -> Column:
    """Equality of columns with their copies, whose names end in an underscore; nulls are equal."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return on


def upper_median(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """Per key the whole row in the middle by `value`, the upper one of two; ties in order of `ties`, nulls first.

    Rows are counted by value before the shuffle, running sums over the values find the middle one, and only rows with
    that value are shuffled and sorted: a key with many rows weighs no more than its number of different values.
    """
    group = Window.partitionBy(*keys)
    up_to, half = F.sum("n_").over(group.orderBy(value)), F.floor(F.sum("n_").over(group) / 2) + 1
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_")).withColumn("place_", half - up_to + F.col("n_"))
    middle = counted.filter("place_ between 1 and n_").select(*[F.col(c).alias(f"{c}_") for c in [*keys, value]], "place_")
    rows = df.join(middle, _same([*keys, value])).withColumn("place", F.row_number().over(group.orderBy(*ties)))
    return rows.filter("place = place_").select(*df.columns)


def span_median(df: DataFrame, keys: list[str], value: str, ties: list[str], slide: int, mask: str | None = None, n: int = 0, name: str = "window_start") -> DataFrame:
    """upper_median per window, [query] and key of rows that are in each window from `first_window` to `last_window` and in
    each query of `mask` below n: df's columns but these, with `name` and qid.

    What is copied into windows and queries are counts by value, span and mask, not the rows. df is read twice, so a join
    before this is best written once.
    """
    spans = ["first_window", "last_window"]
    short = df.groupBy(*keys, value, *spans, *([mask] if mask else [])).agg(F.count(F.lit(1)).alias("n_"))
    each = short.withColumn(name, F.explode(F.sequence(*spans, F.lit(slide)))).drop(*spans)
    by = [name, *keys]
    if mask:
        each, by = per_query(each, n, mask), ["qid", *by]
    group = Window.partitionBy(*by)
    counted = each.groupBy(*by, value).agg(F.sum("n_").alias("n_"))
    up_to, half = F.sum("n_").over(group.orderBy(value)), F.floor(F.sum("n_").over(group) / 2) + 1
    middle = counted.withColumn("place_", half - up_to + F.col("n_")).filter("place_ between 1 and n_").select(*[F.col(c).alias(f"{c}_") for c in [*by, value]], "place_")
    on = _same([*keys, value]) & F.col(f"{name}_").between(F.col(spans[0]), F.col(spans[1]))
    if mask:
        on = on & holds(F.col(mask), F.col("qid_"), is_words(df, mask))
    rows = df.join(middle, on).withColumn(name, F.col(f"{name}_"))
    rows = rows.withColumn("qid", F.col("qid_")) if mask else rows
    rows = rows.withColumn("place", F.row_number().over(group.orderBy(*ties))).filter("place = place_")
    return rows.select(*[c for c in df.columns if c not in (*spans, mask)], name, *(["qid"] if mask else []))


def mean(df: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def total(df: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def sliding_mean(df: DataFrame, ms: str, size: int, slide: int, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    """Mean per sliding window and key, by panes."""
    out = paned(df, ms, size, slide, keys, {"s_": F.sum(value), "n_": F.count(value)}, {"s_": F.sum("s_"), "n_": F.sum("n_")})
    return out.select("window_start", *keys, (F.col("s_").cast("double") / F.col("n_")).alias(name))


def sliding_sum(df: DataFrame, ms: str, size: int, slide: int, keys: list[str], value: str, name: str = "total") -> DataFrame:
    return paned(df, ms, size, slide, keys, {name: F.sum(value)}, {name: F.sum(name)})


def top_mean(df: DataFrame, keys: list[str], value: str, n: int = 10, name: str = "mean") -> DataFrame:
    """Mean of the n highest values per key."""
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    return df.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n).groupBy(*keys).agg(F.avg(value).alias(name))


def sliding_top_mean(df: DataFrame, ms: str, size: int, slide: int, keys: list[str], value: str, n: int = 10, name: str = "mean") -> DataFrame:
    """top_mean per sliding window, by panes: the n highest of a pane are found once, and what is copied into windows comes
    after the last sort. Needs size % slide == 0.

    Windows with the same first pane follow from it: they begin after the pane before, and hold what lies within a size.
    """
    if size % slide:
        raise ValueError("panes need a size that is a multiple of the slide")
    rows = df.filter(F.col(ms).isNotNull()).select(*keys, floor_to(ms, slide).alias("pane_"), F.col(value).alias("v_"))
    rows = rows.withColumn("place_", F.row_number().over(Window.partitionBy(*keys, "pane_").orderBy(F.col("v_").desc()))).filter(F.col("place_") <= n)
    order = Window.partitionBy(*keys).orderBy("pane_")
    near = F.collect_list(F.struct("pane_", "v_")).over(order.rangeBetween(0, size - slide))
    panes = rows.withColumn("near_", near).filter("place_ = 1").withColumn("after_", F.lag("pane_").over(order) + slide)
    first = F.col("pane_") - size + slide
    each = panes.withColumn("window_start", F.explode(F.sequence(F.greatest(first, "after_"), F.col("pane_"), F.lit(slide))))
    inside = F.filter("near_", lambda x: (x["pane_"] < F.col("window_start") + size) & x["v_"].isNotNull())
    each = each.withColumn("top_", F.slice(F.sort_array(F.transform(inside, lambda x: x["v_"]), asc=False), 1, n))
    total = F.aggregate("top_", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return each.select("window_start", *keys, F.when(F.size("top_") > 0, total / F.size("top_")).alias(name))


#: Length of the ranges of time that running maxima are cut into.
RANGE = DAY


def _ranged(df: DataFrame, keys: list[str], by: str, step: int) -> DataFrame:
    """With `part_` instead of the keys: they and the range of time, a struct, as structs with equal nulls are equal."""
    return df.withColumn("part_", F.struct(F.struct(*keys).alias("key"), floor_to(by, step).alias("range"))).drop(*(k for k in keys if k != by))


def _unranged(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"part_.key.{c}").alias(c) if c in keys else F.col(c) for c in columns])


def _before(ranged: DataFrame, value: str) -> DataFrame:
    """(part_, before_): the greatest value of the key in all ranges before; a key has one short row per range here."""
    tops = ranged.groupBy("part_").agg(F.max(value).alias("top_"))
    earlier = Window.partitionBy("part_.key").orderBy("part_.range").rowsBetween(Window.unboundedPreceding, -1)
    return tops.select("part_", F.max("top_").over(earlier).alias("before_"))


def rising(df: DataFrame, keys: list[str], value: str, order: list[str], step: int = RANGE) -> DataFrame:
    """Rows whose value exceeds every earlier one of their key; the first of `order` is a time in ms.

    First within ranges of `step` ms, so that a key is as many tasks as it has ranges; what is left there is held against
    the greatest value of the ranges before. Both read one shuffle if the caller needs no columns but those named here.
    """
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    exceeds = lambda c: F.col(c).isNull() | (F.col(value) > F.col(c))
    records = _ranged(df, keys, order[0], step).withColumn("peak_", F.max(value).over(within)).filter(exceeds("peak_")).drop("peak_")
    return _unranged(records.join(_before(records, value), "part_").filter(exceeds("before_")), df.columns, keys)


def running_peak(df: DataFrame, keys: list[str], value: str, order: list[str], floor: int = 0, name: str = "peak", step: int = RANGE) -> DataFrame:
    """Every row with the greatest value of its key so far, `floor` at least; by ranges of time as in `rising`."""
    so_far = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = _ranged(df, keys, order[0], step)
    rows = ranged.join(_before(ranged, value), "part_").withColumn(name, F.greatest(F.max(value).over(so_far), "before_", F.lit(floor)))
    return _unranged(rows, [*df.columns, name], keys)


def window_records(df: DataFrame, ms: str, size: int, keys: list[str], value: str, order: list[str], carried: list[str], floor: int = 0) -> DataFrame:
    """Per key and tumbling window its greatest value, if it exceeds all windows before and `floor`; with the `carried`
    columns of the first row in `order` that had it. Columns: keys, window_start, value, carried."""
    first = F.max(F.struct(F.col(value).alias("v"), *[(-F.col(o)).alias(f"o{i}") for i, o in enumerate(order)], *carried)).alias("best")
    best = df.groupBy(*keys, floor_to(ms, size).alias("window_start")).agg(first).select(*keys, "window_start", F.col("best.v").alias(value), *[F.col(f"best.{c}").alias(c) for c in carried])
    return rising(best, keys, value, ["window_start"], 64 * size).filter(F.col(value) > floor)


def array_median(value: str, columns: list[str]) -> Column:
    """The upper median as one aggregate: for streams, where the state holds the window's values."""
    items = F.array_sort(F.collect_list(F.struct(value, *columns)))
    return F.element_at(items, (F.floor(F.size(items) / 2) + 1).cast("int"))


def array_top_mean(value: str, n: int = 10) -> Column:
    """The mean of the n highest values as one aggregate: for streams."""
    best = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, n)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
