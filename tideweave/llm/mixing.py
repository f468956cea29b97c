"""Mixing sources to target weights, by Efraimidis-Spirakis keys; DataFrame operations only.

Each document gets the key -ln(u) / w: u is a uniform number from the md5 of seed and doc_id, w its quality weight.
Sorted by key within its source, documents are a weighted sample without replacement of every length at once. Targets
share the total by weight, stop at three times a source's size, and the excess goes to the others by weight. A source
takes all its documents floor(target / size) times, then documents in key order while their running sum fits the rest;
the document across the end gives the words still missing.

The running sum is taken in steps, because one source may hold a third of all rows: ranges of keys are summed first,
then finer ranges within them, then documents within these. Ranges are even in the key's logarithm, whose density is
below 0.4 whatever the weights, so no range holds more than its share; rows that agree in everything count as one row
with a number. The table of sources has a row per source and is summed by ranges too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Documents in a fine range of keys, at most and about; coarse ranges to a doubling of the key.
RANGE, COARSE = 4096, 16
#: Rows made at once of a row that stands for many equal ones.
BLOCK = 1 << 16
SEED = "mix"


def uniform(seed: str, of) -> F.Column:
    """A uniform number in (0, 1) from the first 52 bits of an md5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(of.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (digits.cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def sized(docs: DataFrame, seed: str = SEED, more=()) -> DataFrame:
    """(doc_id, source, size, key, more): size in words; the quality weight is the share of non-space characters that aren't symbols, at least 0.05."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}[]^~=@_", ""))
    weight = F.greatest(F.lit(0.05), 1.0 - 4.0 * signs / F.greatest(F.length(text), F.lit(1)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), (-F.ln(uniform(seed, F.col("doc_id"))) / weight).alias("key"), *more)


def running(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """rows with, for each (name, column) of sums, the column's sum over the rows before it in `order`: by ranges of
    rows, summed first, so that no task holds all rows."""
    rows = cut(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    ranges = rows.groupBy("range_").agg(*[F.sum(c).alias(f"{n}_") for n, c in sums.items()])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    # one row per range of repartitionByRange: no more than there are shuffle partitions
    ranges = ranges.select("range_", *[zero(f"{n}_", Window.orderBy("range_")).alias(f"{n}_") for n in sums])
    within = Window.partitionBy("range_").orderBy(*order)
    rows = rows.select("*", *[zero(c, within).alias(n) for n, c in sums.items()]).join(F.broadcast(ranges), "range_")
    return rows.select(*[c for c in rows.columns if c not in sums and not c.endswith("_")], *[(F.col(n) + F.col(f"{n}_")).alias(n) for n in sums])


def targets(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target) per source of rows(source, size).

    With sources in the order of cap * size / weight, the first k are full and the others share what is left; k is the
    least for which the next one isn't above its cap. The table has a row per source.
    """
    name = F.col("source").asc_nulls_last()
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    per = running(per, [name], {"rank": "one"}).withColumn("w", F.col("rank") % 3 + 1)
    per = cut(running(per.withColumn("full", F.col("source_size") * 6 / F.col("w")), [F.col("full"), name], {"gone": "source_size", "spent": "w"}))
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    per = per.withColumn("unit", (F.lit(whole.size) - cap * F.col("gone")).cast("double") / (F.lit(whole.w) - F.col("spent")))
    level = per.agg(F.min(F.when(F.col("unit") * F.col("w") <= cap * F.col("source_size"), F.struct("spent", "unit"))).alias("least")).first().least
    return per.select("source", "source_size", "n", F.least(F.lit(float("inf") if level is None else level.unit) * F.col("w"), (cap * F.col("source_size")).cast("double")).alias("target"))


def _start(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, by, start): the words of each group before it, in the order of `by` within keys."""
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys, by).agg(F.sum("words").alias("held")).select(*keys, by, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias(f"before_{by}"))


def _mix(rows: DataFrame, cap: int, range_size: int) -> DataFrame:
    """rows(doc_id, source, size, key, more) to distinct rows with their number (equal), their source's size and
    target, whole epochs, and the words that the last one has room for at the first of the equal rows (room)."""
    rows = cut(rows)
    goal = cut(targets(rows, cap).withColumn("of", F.coalesce(F.concat(F.lit("."), "source"), F.lit(""))))
    rows = rows.join(goal.drop("source"), F.coalesce(F.concat(F.lit("."), "source"), F.lit("")) == F.col("of"))
    doubling = F.log2("key") * COARSE
    finer = F.ceil(F.col("n") / (COARSE * range_size))
    rows = rows.withColumn("coarse", F.floor(doubling).cast("int")).withColumn("fine", F.floor(doubling * finer)).drop("n")
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("equal")).withColumn("words", F.col("size") * F.col("equal")))
    within = Window.partitionBy("of", "coarse", "fine").orderBy("key", "doc_id", "size", *[c for c in ("print",) if c in rows.columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("words").over(within)).join(_start(rows, ["of", "coarse"], "fine"), ["of", "coarse", "fine"]).join(_start(rows, ["of"], "coarse"), ["of", "coarse"])
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size"))))
    room = F.floor(F.col("target") + 0.5) - F.col("epochs") * F.col("source_size") - (F.col("before_coarse") + F.col("before_fine") + F.col("upto") - F.col("words"))
    return placed.withColumn("epochs", epochs.cast("bigint")).withColumn("room", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(room))


def mix_sources(docs: DataFrame, cap: int = CAP, seed: str = SEED, range_size: int = RANGE) -> DataFrame:
    """docs(doc_id, text, source, ...) to (doc_id, size, source_size, target, taken), one row per row of docs.

    Sources (null is one of its own, last in order) weigh 1, 2, 3, repeating by code point. Null texts have size 0 and
    nothing is taken of them. A text of any length is one value in one task. Rows with equal keys go by doc_id and size;
    rows that agree in all are interchangeable. Equal inputs give equal mixes. Other columns are ignored, so their names
    can't clash; an empty table gives no rows.
    """
    rows = _mix(sized(docs, seed), cap, range_size)
    # of equal rows, the first ones fit whole, one may fit in part, the rest don't
    whole = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("equal"), F.floor(F.col("room") / F.col("size"))))).otherwise(F.col("equal"))
    rows = rows.withColumn("whole", whole)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("whole") * F.col("size")))
    kinds = [(F.col("size"), F.col("whole")), (part, F.least(F.lit(1), F.col("equal") - F.col("whole"))), (F.lit(0), F.greatest(F.lit(0), F.col("equal") - F.col("whole") - 1))]
    rows = rows.withColumn("kind", F.explode(F.array(*[F.struct((F.col("epochs") * F.col("size") + more).cast("bigint").alias("taken"), times.cast("bigint").alias("times")) for more, times in kinds]))).filter("kind.times > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("kind.times") - 1) / BLOCK))))
    copies = F.array_repeat(F.lit(0), F.least(F.lit(BLOCK), F.col("kind.times") - F.col("block") * BLOCK).cast("int"))
    return rows.select("doc_id", "size", "source_size", "target", F.col("kind.taken").alias("taken"), F.explode(copies).alias("copy")).drop("copy")


def mixed(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it: whole copies, the one at a source's end if half of it or more fits.

    Rows that agree in doc_id, source and text come equally often, by the rounded mean. Rows without words don't come;
    an empty table gives no rows. All columns stay as they are, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = _mix(sized(docs, seed, [F.xxhash64(text).alias("print")]), cap, RANGE).filter("size > 0")
    fits = F.floor(F.greatest(F.lit(0), F.least(F.col("equal"), F.col("room") / F.col("size"))) + 0.5)
    copies = F.floor(F.col("epochs") + fits / F.col("equal") + 0.5).cast("int")
    taken = taken.select(F.col("of").alias("t_of"), F.col("doc_id").alias("t_id"), F.col("print").alias("t_print"), copies.alias("t_copies")).filter("t_copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("print"), F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit("")).alias("of"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("of") == F.col("t_of")) & (F.col("print") == F.col("t_print")))
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("t_copies")))).select("doc.*")
