"""Many queries over one computation: each row carries the set of queries that it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import WORD, mask_of, mask_words, queries_in, some, words_in

#: Rows up to which a table of predicates or switches is broadcast.
SMALL = 10_000
Ranges = list[tuple[int, int, int]]


def stamp(df: DataFrame, active: list[int], name: str = "qmask") -> DataFrame:
    """Every row belongs to all active queries: one mask up to number 62, an array of masks beyond."""
    words = [sum(1 << q % WORD for q in active if q // WORD == i) for i in range(max(active, default=0) // WORD + 1)]
    return df.withColumn(name, F.array(*[F.lit(w).cast("bigint") for w in words]) if len(words) > 1 else F.lit(words[0]).cast("bigint"))


def assign(df: DataFrame, ranges: Ranges, attr: str = "filter_attr", name: str = "qmask") -> DataFrame:
    """Rows with the queries whose range (query, lo, hi) holds `attr`; rows in none go. One mask up to query number 62,
    an array of masks beyond.

    The hull of all ranges is a plain predicate as well, so that a scan can skip data by it.
    """
    if not ranges:
        return df.withColumn(name, F.lit(0).cast("bigint")).filter(F.lit(False))
    hull = df.filter(F.col(attr).between(min(r[1] for r in ranges), max(r[2] for r in ranges)))
    integral = dict(df.dtypes)[attr] in ("tinyint", "smallint", "int", "bigint")
    words = max(r[0] for r in ranges) >= WORD
    return hull.withColumn(name, (mask_words if words else mask_of)(attr, ranges, integral)).filter(some(F.col(name), words))


def assign_by_table(df: DataFrame, predicates: DataFrame, row_id: str, attr: str = "filter_attr", width: int = 16) -> DataFrame:
    """The same against a table (qid, lo, hi) of any size: rows get an array of qids.

    A small table is broadcast. Beyond SMALL rows, predicates are cut to the attribute's span and dealt to buckets of
    `width` values, so that the join is an equi-join on (bucket).
    """
    if predicates.count() <= SMALL:
        inside = df.join(F.broadcast(predicates), F.col(attr).between(F.col("lo"), F.col("hi")))
    else:
        span = df.agg(F.min(attr).alias("least"), F.max(attr).alias("most")).first()
        if span.least is None:
            return df.withColumn("qids", F.array().cast("array<int>")).filter(F.lit(False))
        low, high = F.greatest("lo", F.lit(span.least)), F.least("hi", F.lit(span.most))
        dealt = predicates.filter(low <= high).withColumn("bucket_", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
        inside = df.withColumn("bucket", F.floor(F.col(attr) / width)).join(dealt, F.expr(f"bucket = bucket_ and {attr} between lo and hi"))
    sets = inside.groupBy(row_id).agg(F.sort_array(F.collect_set("qid")).alias("qids"))
    return df.join(sets, row_id)


def active_at(df: DataFrame, control: DataFrame, n: int, ms: str = "ms", name: str = "qmask") -> DataFrame:
    """Keeps of each row's queries those that are active at its time, by control(qid, active_from, active_to) in ms, end
    exclusive; a query may have several spans. A small control table is broadcast, a larger one joined on qid."""
    control = F.broadcast(control) if control.count() <= SMALL else control
    rows = df.withColumn("qid", F.explode(queries_in(name, n))).join(control, "qid")
    return rows.filter((F.col(ms) >= F.col("active_from")) & (F.col(ms) < F.col("active_to"))).drop("active_from", "active_to")


def per_query(df: DataFrame, n: int, mask: str = "qmask", name: str = "qid") -> DataFrame:
    """A row for each query of a row's set."""
    return df.withColumn(name, F.explode((words_in if is_words(df, mask) else queries_in)(mask, n))).drop(mask)


def is_words(df: DataFrame, mask: str) -> bool:
    return dict(df.dtypes)[mask].startswith("array")


def of_query(df: DataFrame, q: int, mask: str = "qmask") -> DataFrame:
    """The rows of one query."""
    held = F.element_at(mask, q // WORD + 1) if is_words(df, mask) else F.col(mask)
    return df.filter(held.bitwiseAND(F.lit(1 << q % WORD).cast("bigint")) != 0)
