"""Event-time windows as epoch milliseconds: a window is [start, start + size), starts are multiples of slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ms, step: int) -> Column:
    return _col(ms) - F.pmod(_col(ms), F.lit(step))


def first_start(ms, size: int, slide: int) -> Column:
    """First window that holds a time."""
    return floor_to(_col(ms) - size, slide) + slide


def starts(ms, size: int, slide: int) -> Column:
    """All windows that hold a time, as an array."""
    if size == slide:
        return F.array(floor_to(ms, slide))
    return F.sequence(first_start(ms, size, slide), floor_to(ms, slide), F.lit(slide)) if size > slide else F.filter(F.array(floor_to(ms, slide)), lambda w: w > _col(ms) - size)


def with_windows(df: DataFrame, ms, size: int, slide: int, name: str = "window_start") -> DataFrame:
    """A row for each window that holds the row's time."""
    if size == slide:
        return df.withColumn(name, floor_to(ms, slide))
    return df.withColumn(name, F.explode(starts(ms, size, slide)))


def shared_starts(one, two, size: int, slide: int) -> tuple[Column, Column]:
    """First and last window that hold both times; none if the first is greater."""
    return first_start(F.greatest(_col(one), _col(two)), size, slide), floor_to(F.least(_col(one), _col(two)), slide)


def emitted_at(window_start, size: int) -> Column:
    """Time of a window's results: its last millisecond."""
    return _col(window_start) + (size - 1)


def paned(df: DataFrame, ms, size: int, slide: int, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], name: str = "window_start") -> DataFrame:
    """Sliding aggregates from per-slide panes: rows are aggregated once, and only panes are copied into windows.

    `partial` names the aggregates of a pane, `merge` those of its columns over panes. Needs size % slide == 0.
    """
    if size % slide:
        raise ValueError("panes need a size that is a multiple of the slide")
    panes = df.groupBy(floor_to(ms, slide).alias("pane"), *keys).agg(*[c.alias(n) for n, c in partial.items()])
    return with_windows(panes, "pane", size, slide, name).groupBy(name, *keys).agg(*[c.alias(n) for n, c in merge.items()])
