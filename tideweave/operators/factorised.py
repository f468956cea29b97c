"""Aggregates over joins without the pairs: products of each side's counts, and counts by sweeps over time."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import emitted_at, first_start, floor_to, starts
from ..sources.sinks import once
from .joins import near_in_time
from .queryset import per_query


#: Windows a row from which sums over a join go by pairs of panes: with three windows sides that meet in each of them
#: take 4.5 s where panes take 5.8, with six 7.1 s against 2.5 (shared_join_mean and window_join_agg on sf0.1).
PANES = 4
#: Sizes of a window in a bucket in which panes meet: one pane in four has a second copy, and a hot key's panes are held
#: against those of ten sizes at most.
BUCKET = 8


def in_windows(df: DataFrame, ms: str, size: int, slide: int, keys: list[str], sums: list[str], mask: str | None = None, n: int = 0) -> DataFrame:
    """(window_start, [qid], keys, n, and the sum and the number of each column of `sums`) for each window that has rows.

    Rows that are in the same windows and queries are counted before anything is copied: what is exploded into windows
    and queries is a row per key, mask and pane, not the input.
    """
    first, last = first_start(ms, size, slide), floor_to(ms, slide)
    partial = [F.count(F.lit(1)).alias("n"), *[c for s in sums for c in (F.sum(s).alias(f"sum_{s}"), F.count(s).alias(f"n_{s}"))]]
    panes = df.groupBy(*keys, first.alias("first_"), last.alias("last_"), *([mask] if mask else [])).agg(*partial).filter("first_ <= last_")
    rows = panes.withColumn("window_start", F.explode(F.sequence("first_", "last_", F.lit(slide)))).drop("first_", "last_")
    by = ["window_start", *keys]
    if mask:
        rows, by = per_query(rows, n, mask), ["qid", *by]
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *[x for s in sums for x in (f"sum_{s}", f"n_{s}")])])


def in_panes(df: DataFrame, ms: str, size: int, slide: int, keys: list[str], sums: list[str], mask: str | None = None, n: int = 0) -> DataFrame:
    """(last_, [qid], keys, n, and the sum and the number of each column of `sums`) per pane: rows that are in the same
    windows, up to last_, and of one query; with first_, unless it is last_ - size + slide for all."""
    ends = [] if size % slide == 0 else ["first_"]
    partial = [F.count(F.lit(1)).alias("n"), *[c for s in sums for c in (F.sum(s).alias(f"sum_{s}"), F.count(s).alias(f"n_{s}"))]]
    first = first_start(ms, size, slide)
    panes = df.groupBy(*keys, *[first.alias(c) for c in ends], floor_to(ms, slide).alias("last_"), *([mask] if mask else [])).agg(*partial).filter("first_ <= last_" if ends else "last_ is not null")
    if not mask:
        return panes
    return per_query(panes, n, mask).groupBy("qid", *keys, *ends, "last_").agg(*[F.sum(c).alias(c) for c in ("n", *[x for s in sums for x in (f"sum_{s}", f"n_{s}")])])


def spread(spans: DataFrame, by: list[str], slide: int, measures: list[str]) -> DataFrame:
    """spans(by, first_, last_, measures) to (window_start, by, sums of the measures over the spans that hold the window).

    A span is a rise at its first window and a fall after its last; running sums over those, in order of time, hold from
    each to the next. They are exact for whole numbers and decimals. A group is a row per window in which something
    begins or ends, whatever the number of spans.
    """
    turn = lambda at, sign: F.struct(at.alias("at"), *[(sign * F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures])
    turns = spans.select(*by, F.explode(F.array(turn(F.col("first_"), 1), turn(F.col("last_") + slide, -1))).alias("x_"))
    turns = turns.groupBy(*by, F.col("x_.at").alias("at_")).agg(*[F.sum(f"x_.{m}").alias(m) for m in measures])
    order = Window.partitionBy(*by).orderBy("at_")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = turns.select(*by, "at_", F.lead("at_").over(order).alias("next_"), *[F.sum(m).over(so_far).alias(m) for m in measures])
    return held.filter("next_ is not null").withColumn("window_start", F.explode(F.sequence("at_", F.col("next_") - slide, F.lit(slide)))).drop("at_", "next_")


def window_join_sums(one: DataFrame, two: DataFrame, key: tuple[str, str], times: tuple[str, str], size: int, slide: int, by: list[str], sums: list[str], masks: tuple[str, str] | None = None, n: int = 0) -> DataFrame:
    """What in_each_window(window_join(one, two, ...)), grouped by window, query and `by`, gives for counts and sums:
    ([qid], window_start, by, n, and sum_ and n_ of each of `sums`), without a pair of rows in the plan.

    The pairs of two groups of rows number the product of both sides' rows, and each row of one side comes as often as
    the other has rows. From PANES windows a row, panes are joined, once per pair of panes that share windows, and the
    products are spread over these: a key of few rows is a few pairs of panes, a hot one at most two per pane, window and
    query. With fewer windows, and for sums of floating-point numbers, which can't be taken back exactly, sides meet on
    (query, window, key). `by` may name columns of either side.
    """
    parts, floating = [], False
    for df, k, ms, mask in ((one, key[0], times[0], masks and masks[0]), (two, key[1], times[1], masks and masks[1])):
        own, mine = [c for c in by if c in df.columns and c != k], [s for s in sums if s in df.columns]
        floating |= any(dict(df.dtypes)[s] in ("float", "double") for s in mine)
        parts.append((df.filter(F.col(k).isNotNull()), k, ms, mask, own, mine))
    by_pane = size >= PANES * slide and not floating
    counted = [(in_panes if by_pane else in_windows)(df, ms, size, slide, [k, *own], mine, mask, n) for df, k, ms, mask, own, mine in parts]
    at = (["last_"] if size % slide == 0 else ["first_", "last_"]) if by_pane else ["window_start"]
    qid = ["qid"] if masks else []

    def side(i: int, name: str) -> DataFrame:
        _, k, _, _, own, mine = parts[i]
        return counted[i].select(*[F.col(c).alias(f"{c}{name}") for c in (*qid, *at)], F.col(k).alias(f"key_{name}"), *own, F.col("n").alias(f"n{name}"), *[c for s in mine for c in (f"sum_{s}", f"n_{s}")])

    a, b = side(0, "a"), side(1, "b")
    if by_pane:
        first_of = lambda x: F.col(f"first_{x}") if "first_" in at else F.col(f"last_{x}") - size + slide
        first, last = F.greatest(first_of("a"), first_of("b")), F.least("last_a", "last_b")
        pairs = near_in_time(a, b, [*[(f"{c}a", f"{c}b") for c in (*qid, "key_")]], ("last_a", "last_b"), size, first <= last, step=BUCKET * size)
        at = [first.alias("first_"), last.alias("last_")]
    else:
        pairs = a.join(b, reduce(Column.__and__, [F.col(f"{c}a") == F.col(f"{c}b") for c in (*qid, "window_start", "key_")]))
        at = [F.col("window_starta").alias("window_start")]
    for k in key:
        if k in by:
            pairs = pairs.withColumn(k, F.col("key_a"))
    times_other = {s: F.col("nb") if s in parts[0][5] else F.col("na") for s in sums}
    products = {"n": F.col("na") * F.col("nb")} | {f"{c}_{s}": F.col(f"{c}_{s}") * times_other[s] for s in sums for c in ("sum", "n")}
    pairs = pairs.withColumnsRenamed({f"{c}a": c for c in qid})
    joined = pairs.groupBy(*qid, *at, *by).agg(*[F.sum(v).alias(c) for c, v in products.items()])
    if not by_pane:
        return joined
    windows = spread(joined, [*qid, *by], slide, list(products)).filter("n > 0")
    return windows.select(*qid, "window_start", *by, "n", *[c for s in sums for c in (F.when(F.col(f"n_{s}") > 0, F.col(f"sum_{s}")).alias(f"sum_{s}"), F.col(f"n_{s}"))])


def three_way_counts(one: DataFrame, two: DataFrame, three: DataFrame, first: tuple[str, str], second: tuple[str, str], times: tuple[str, str, str], size: int, masks: tuple[str, str, str], n: int) -> DataFrame:
    """(qid, window_start, n): triples of three_way over tumbling windows, from the middle rows' counts times those of
    both their partners."""
    a = in_windows(one.filter(F.col(first[0]).isNotNull()), times[0], size, size, [first[0]], [], masks[0], n).withColumnRenamed("n", "na")
    b = in_windows(two, times[1], size, size, [first[1], second[0]], [], masks[1], n).withColumnRenamed("n", "nb")
    c = in_windows(three.filter(F.col(second[1]).isNotNull()), times[2], size, size, [second[1]], [], masks[2], n).withColumnRenamed("n", "nc")
    at = ["qid", "window_start"]
    ab = b.withColumnRenamed(first[1], "key_").join(a.withColumnRenamed(first[0], "key_"), [*at, "key_"]).groupBy(*at, F.col(second[0]).alias("key_")).agg(F.sum(F.col("na") * F.col("nb")).alias("nab"))
    return ab.join(c.withColumnRenamed(second[1], "key_"), [*at, "key_"]).groupBy(*at).agg(F.sum(F.col("nab") * F.col("nc")).alias("n"))


def first_triples(one: DataFrame, two: DataFrame, three: DataFrame, first: tuple[str, str], second: tuple[str, str], times: tuple[str, str, str], size: int, ids: tuple[str, str]) -> DataFrame:
    """Of three_way's triples over tumbling windows, per window and row of `one` the first in order of `ids`, of the second
    and of the third: `one` with window_start and ids. Each side is reduced to a row per window and key before it is joined."""
    at = lambda i: floor_to(times[i], size).alias("window_start")
    least = F.when(F.count(ids[1]) == F.count(F.lit(1)), F.min(ids[1])).alias(ids[1])  # null is least
    c = three.groupBy(at(2), F.col(second[1]).alias("key_")).agg(least)
    b = two.select(at(1), F.col(first[1]).alias("one_"), F.col(second[0]).alias("key_"), ids[0]).join(c, ["window_start", "key_"])
    b = b.groupBy("window_start", "one_").agg(F.min(F.struct(*ids)).alias("ids_"))
    rows = one.withColumn("window_start", at(0)).withColumn("one_", F.col(first[0])).join(b, ["window_start", "one_"])
    return rows.select(*one.columns, "window_start", *[F.col(f"ids_.{c}").alias(c) for c in ids])


def _nth(counted: DataFrame, order: str) -> DataFrame:
    """Of rows (group_, place_, order, n_) those that hold the place-th of their group in order, with the place within them."""
    up_to = F.sum("n_").over(Window.partitionBy("group_").orderBy(order))
    held = counted.withColumn("up_to_", up_to).filter("place_ > up_to_ - n_ and place_ <= up_to_")
    return held.withColumn("place_", F.col("place_") - F.col("up_to_") + F.col("n_")).drop("n_", "up_to_")


#: Ranges of the first side's ids in which three_way_median counts pairs.
ID_RANGES = 256


def three_way_median(one: DataFrame, two: DataFrame, three: DataFrame, first: tuple[str, str], second: tuple[str, str], times: tuple[str, str, str], size: int, slide: int, by: list[str], value: str, ids: tuple[str, str, str]) -> DataFrame:
    """(window_start, by, ids of the first and of the third, value): upper_median of three_way's triples per window and
    `by`, in order of value, ids and the pair's window; by and value are the third side's columns, ids are numbers.

    No triple is built but those of the two rows that the median has. What is counted, from each side's counts, is first
    triples by value, then of the middle value by range of the first's ids, then in the one range by id, then by the
    second's id. Pairs are a row per window, key and range; the rest is linear in the rows of each side. A side's rows are
    copied into windows only to be counted; where they are looked up, the few spots looked for are copied, into steps.
    """
    a_id, b_id, c_id = ids
    splits = sorted(set(one.approxQuantile(a_id, [i / ID_RANGES for i in range(1, ID_RANGES)], 0.5 / ID_RANGES))) or [0.0]
    ranges = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="id_", outputCol="range_")
    held = lambda i: (first_start(times[i], size, slide).alias("first_"), floor_to(times[i], slide).alias("step_"))
    in_each = lambda df, name: df.withColumn(name, F.explode(F.sequence("first_", "step_", F.lit(slide)))).drop("first_", "step_")
    in_steps = lambda df, at: df.withColumn("step_", F.explode(F.sequence(at, floor_to(F.col(at) + (size - 1), slide), F.lit(slide))))
    a = one.filter(F.col(first[0]).isNotNull()).select(*held(0), F.col(first[0]).alias("one_"), F.col(a_id), F.coalesce(F.col(a_id).cast("double"), F.lit(-float("inf"))).alias("id_"))
    a = ranges.transform(a.filter("first_ <= step_")).drop("id_")
    b = two.select(*held(1), F.col(first[1]).alias("one_"), F.col(second[0]).alias("key_"), b_id).filter("one_ is not null and key_ is not null and first_ <= step_")
    c = three.select(*held(2), F.col(second[1]).alias("key_"), *by, value, c_id).filter("key_ is not null and first_ <= step_")
    later = F.explode(starts(emitted_at("at_", size), size, slide))  # a pair's time is the end of its window
    earlier = F.explode(starts("window_", size, slide))  # pairs' windows that end in a window
    counted_b = in_each(b, "at_").groupBy("at_", "one_", "key_").agg(F.count(F.lit(1)).alias("nb_"))
    counted_a = in_each(a, "at_").groupBy("at_", "one_", "range_").agg(F.count(F.lit(1)).alias("na_"))
    pairs = counted_a.join(counted_b, ["at_", "one_"]).groupBy("at_", "key_", "range_").agg(F.sum(F.col("na_") * F.col("nb_")).alias("n_"))
    pairs = once(pairs.withColumn("window_", later).groupBy("window_", "key_", "range_").agg(F.sum("n_").alias("n_")))

    # the middle value, and the third side's rows that have it
    of_key = pairs.groupBy("window_", "key_").agg(F.sum("n_").alias("p_"))
    valued = in_each(c, "window_").groupBy("window_", "key_", F.struct("window_", *by).alias("group_"), value).agg(F.count(F.lit(1)).alias("m_")).join(of_key, ["window_", "key_"])
    valued = valued.groupBy("group_", value).agg(F.sum(F.col("m_") * F.col("p_")).alias("n_"))
    middle = _nth(valued.withColumn("place_", F.floor(F.sum("n_").over(Window.partitionBy("group_")) / 2) + 1), value)
    middle = in_steps(middle.select("group_", F.col("group_.window_").alias("window_"), *[F.col(f"group_.{k}").alias(f"{k}_") for k in by], F.col(value).alias("v_"), "place_"), "window_").withColumnRenamed("step_", "s_")
    same = (F.col("step_") == F.col("s_")) & (F.col("first_") <= F.col("window_")) & F.col(value).eqNullSafe(F.col("v_"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by], same)
    chosen = once(c.join(middle, same).select("window_", "key_", "group_", value, c_id, "place_"))
    weights = chosen.groupBy("window_", "group_", "key_", "place_").agg(F.count(F.lit(1)).alias("m_"))
    weight = weights.drop("window_", "place_")

    # the range of the first's id, the id, the second's id
    ranged = weights.join(pairs, ["window_", "key_"]).groupBy("window_", "group_", "place_", "range_").agg(F.sum(F.col("m_") * F.col("n_")).alias("n_"))
    spot = _nth(ranged, "range_")
    near = a.join(in_steps(spot.withColumn("at_", earlier), "at_"), ["step_", "range_"]).filter("first_ <= at_").drop("first_", "step_")
    near = near.join(counted_b, ["at_", "one_"]).join(weight, ["group_", "key_"])
    spot = _nth(near.groupBy("window_", "group_", "place_", a_id).agg(F.sum(F.col("m_") * F.col("nb_")).alias("n_")), a_id)
    spot = in_steps(spot.select("group_", "place_", F.col(a_id).alias("a_"), earlier.alias("at_")), "at_").withColumnRenamed("step_", "s_")
    mine = a.join(spot, (F.col("step_") == F.col("s_")) & (F.col("first_") <= F.col("at_")) & F.col(a_id).eqNullSafe(F.col("a_")))
    mine = in_steps(mine.select("group_", "place_", "at_", "one_", a_id), "at_").join(b, ["step_", "one_"]).filter("first_ <= at_")
    mine = once(mine.select("group_", "place_", "at_", "key_", a_id, b_id))
    spot = _nth(mine.join(weight, ["group_", "key_"]).groupBy("group_", "place_", b_id).agg(F.sum("m_").alias("n_")), b_id)
    spot = spot.select(F.col("group_").alias("g_"), F.col(b_id).alias("b_"), F.col("place_").alias("left_"))
    last = mine.join(spot, (F.col("group_") == F.col("g_")) & F.col(b_id).eqNullSafe(F.col("b_"))).join(chosen.select("group_", "key_", value, c_id), ["group_", "key_"])
    last = last.withColumn("nth_", F.row_number().over(Window.partitionBy("group_").orderBy(c_id, "at_"))).filter("nth_ = left_")
    return last.select(F.col("group_.window_").alias("window_start"), *[F.col(f"group_.{c}").alias(c) for c in by], a_id, c_id, value)


def mean_of(column: str) -> Column:
    """The mean, from a sum and a number of window_join_sums."""
    return F.col(f"sum_{column}").cast("double") / F.col(f"n_{column}")


def swept(rows: DataFrame, points: DataFrame, keys: list[str], at: str, home: str, before: int, after: int, measures: list[str], step: int) -> DataFrame:
    """points with running sums of the rows' `measures` over rows of the same keys at `at` or before, each sum counted
    from a start that all points of one `home` share: differences between them are exact.

    One sweep in order of `at` by ranges of `step` of the home; points lie at most `before` (and one) and `after` from
    it. Rows are copied into the ranges from which they can be seen, at most three for a step as long as the reach, so
    there is one shuffle, work is linear in rows and points, and a hot key is as many tasks as it has ranges. Rows with a
    null key or position go, as in a join.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, at]])
    rest = [c for c in points.columns if c not in [*keys, at]]
    seen_from = F.explode(F.array(*[floor_to(at, step) + d * step for d in range(-after // step, -(before // -step) + 1)]))
    events = rows.filter(known).groupBy(*keys, at).agg(*[F.sum(m).alias(m) for m in measures]).withColumn("range_", seen_from)
    events = events.withColumn("point_", F.lit(None).cast(points.select(F.struct(*rest)).schema[0].dataType)).withColumn("kind_", F.lit(0))
    asked = points.filter(known).select(*keys, at, *[F.lit(0).cast(dict(events.dtypes)[m]).alias(m) for m in measures], floor_to(home, step).alias("range_"), F.struct(*rest).alias("point_"), F.lit(1).alias("kind_"))
    so_far = Window.partitionBy(*keys, "range_").orderBy(at, "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = events.unionByName(asked).select(*keys, at, "point_", "kind_", *[F.sum(m).over(so_far).alias(m) for m in measures])
    return sums.filter("kind_ = 1").select(*keys, at, *[F.col(f"point_.{c}").alias(c) for c in rest], *measures)


def band_matches(one: DataFrame, two: DataFrame, keys: list[str], at: str, reach: int, measures: list[str], by: list[str], step: int | None = None, gaps: bool = False) -> DataFrame:
    """Over pairs of equal keys whose positions differ by `reach` at most, per `by` columns of `two`: (by, n_ of each of
    `measures`), the sum of the measure of `one`; with `gaps` also gap_, the sum of the measure times the positions'
    distance, for positions whose sums fit a bigint.

    With a measure of 1 these are the number of pairs and the sum of their distances. No pair is built: what lies
    within reach of a row of `two` is a difference of running sums at three points.
    """
    rows = one.select(*keys, at, *measures, *([(F.col(m) * F.col(at)).alias(f"at_{m}") for m in measures] if gaps else []))
    here = two.groupBy(*keys, at, *by).agg(F.count(F.lit(1)).alias("w_"))
    # the distance is p - x up to p and x - p beyond, so it needs the sums of x up to p - reach - 1, p and p + reach
    spot = lambda d, n, p, s: F.struct((F.col(at) + d).alias("to"), F.col(at).alias("home"), (n * F.col("w_")).alias("n"), *([(p * F.col("w_") * F.col(at)).alias("p"), (s * F.col("w_")).alias("s")] if gaps else []))
    points = here.withColumn("x_", F.explode(F.array(spot(-reach - 1, -1, -1, 1), *([spot(0, 0, 2, -2)] if gaps else []), spot(reach, 1, -1, 1))))
    points = points.select(*keys, F.col("x_.to").alias(at), F.col("x_.home").alias("home_"), *by, F.col("x_.n").alias("n_"), *([F.col("x_.p").alias("p_"), F.col("x_.s").alias("s_")] if gaps else []))
    got = swept(rows, points, keys, at, "home_", reach, reach, [c for c in rows.columns if c not in [*keys, at]], step or max(reach, 1))
    sums = [F.sum(F.col("n_") * F.col(m)).alias(f"n_{m}") for m in measures]
    sums += [F.sum(F.col("p_") * F.col(m) + F.col("s_") * F.col(f"at_{m}")).alias(f"gap_{m}") for m in measures] if gaps else []
    return got.groupBy(*by).agg(*sums)


def partners_before(rows: DataFrame, others: DataFrame, keys: list[str], at: str, reach: int, strictly: bool, step: int | None = None) -> DataFrame:
    """rows with `partners`: how many of `others` with equal keys are at most `reach` before, and earlier if `strictly`."""
    rest = [c for c in rows.columns if c not in [*keys, at]]
    ends = F.array(F.struct((F.col(at) - reach - 1).alias("to"), (-F.col("w_")).alias("w")), F.struct((F.col(at) - int(strictly)).alias("to"), F.col("w_").alias("w")))
    here = rows.groupBy(*keys, at, *rest).agg(F.count(F.lit(1)).alias("w_"))
    points = here.withColumn("x_", F.explode(ends)).select(*keys, F.col("x_.to").alias("to_"), F.col(at), *rest, F.col("x_.w").alias("w_"))
    got = swept(others.select(*keys, F.col(at).alias("to_"), F.lit(1).cast("bigint").alias("one_")), points, keys, "to_", at, reach, 0, ["one_"], step or max(reach, 1))
    return got.withColumn("partners", F.col("w_") * F.col("one_")).drop("to_", "w_", "one_")
