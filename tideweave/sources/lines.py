"""Text lines of the two wire formats to typed rows, and event time; batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arity by tag.
ENTITY_FIELDS = {"A": 16, "B": 16, "C": 16, "JSON": 6}
AUCTION_FIELDS = {"0": 9, "1": 12, "2": 6}


def _checked(lines: DataFrame, separator: str, fields: dict[str, int], strict: bool) -> DataFrame:
    """value -> parts, tag, bad. With `strict` a bad line fails the query when it is read."""
    # through explode, so that a line is made and split once: conditions on its parts would be pushed down and each
    # repeat both, once per mention
    rows = lines.select(F.explode(F.array("value")).alias("value"))
    value = F.regexp_replace("value", "\r$", "")
    rows = rows.select("value", F.explode(F.array(F.split(value, separator, -1))).alias("parts")).withColumn("tag", F.col("parts")[0])
    right = F.lit(False)
    for tag, n in fields.items():
        right = right | ((F.col("tag") == tag) & (F.size("parts") == n))
    right = F.coalesce(right, F.lit(False))
    if strict:
        return rows.withColumn("bad", F.when(~right, F.raise_error(F.concat(F.lit("malformed line: "), F.coalesce("value", F.lit("null")))).cast("boolean")).otherwise(F.lit(False)))
    return rows.withColumn("bad", ~right)


def _text(i: int) -> Column:
    return F.nullif(F.col("parts")[i], F.lit(""))


def _long(i: int) -> Column:
    return F.expr(f"try_cast(parts[{i}] as bigint)")


def entity_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Tab-separated entities (value string). Without `strict`, malformed lines come with `corrupt` set and nulls else."""
    rows = _checked(lines, "\t", ENTITY_FIELDS, strict)
    full, json = ~F.col("bad") & (F.col("tag") != "JSON"), ~F.col("bad") & (F.col("tag") == "JSON")
    good = lambda c: F.when(full, c)
    ms = F.when(~F.col("bad"), _long(2))
    return rows.select(
        F.when(~F.col("bad"), F.col("tag")).alias("type"), F.when(~F.col("bad"), _long(1)).alias("id"), F.timestamp_millis(ms).alias("ts"), ms.alias("ms"), F.when(~F.col("bad"), _long(3)).alias("emit_ms"),
        good(_long(4)).alias("pk"), good(_long(5)).alias("fk"), good(_long(6)).alias("sel1"), good(_long(7)).alias("sel2"), good(_long(8)).alias("long1"), good(_long(9)).alias("long2"), good(_long(10)).cast("int").alias("filter_attr"),
        good(_text(11)).alias("text"), F.when(json, _text(4)).otherwise(good(_text(12))).alias("json"), good(_text(13)).alias("xml"), F.expr("try_to_binary(parts[14], 'base64')").alias("padding"), F.when(F.col("bad"), F.col("value")).alias("corrupt"),
    )


def narrow_lines(lines: DataFrame) -> DataFrame:
    """(is_a, key, filter_attr) of A and B lines: A by its primary, B by its foreign key."""
    rows = _checked(lines, "\t", {"A": 16, "B": 16}, True).filter("not bad")
    is_a = F.col("tag") == "A"
    return rows.select(is_a.alias("is_a"), F.when(is_a, _long(4)).otherwise(_long(5)).cast("int").alias("key"), _long(10).cast("int").alias("filter_attr"))


def auction_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Comma-separated people (0), auctions (1) and bids (2): a type and one filled struct a row."""
    rows = _checked(lines, ",", AUCTION_FIELDS, strict).withColumn("kind", F.when(~F.col("bad"), F.col("tag")))
    at = lambda i: F.expr(f"try_cast(parts[{i}] as timestamp)")
    person = F.struct(_long(1).alias("id"), _text(2).alias("name"), _text(3).alias("email"), _text(4).alias("card"), _text(5).alias("city"), _text(6).alias("state"), at(7).alias("ts"), _text(8).alias("extra"))
    auction = F.struct(_long(1).alias("id"), _text(2).alias("item"), _text(3).alias("description"), _long(4).alias("initial_bid"), _long(5).alias("reserve"), at(6).alias("ts"), at(7).alias("expires"), _long(8).alias("seller"), _long(9).alias("category"), _text(10).alias("extra"), F.expr("try_cast(parts[11] as boolean)").alias("sell_below_reserve"))
    bid = F.struct(_long(1).alias("auction"), _long(2).alias("bidder"), _long(3).alias("price"), at(4).alias("ts"), _text(5).alias("extra"))
    return rows.select(
        F.when(F.col("kind") == "0", "person").when(F.col("kind") == "1", "auction").when(F.col("kind") == "2", "bid").alias("type"),
        F.when(F.col("kind") == "0", person).alias("person"), F.when(F.col("kind") == "1", auction).alias("auction"), F.when(F.col("kind") == "2", bid).alias("bid"), F.when(F.col("bad"), F.col("value")).alias("corrupt"),
    )


def of_type(events: DataFrame, kind: str) -> DataFrame:
    """Rows of one type; a wide auction event becomes its struct's columns."""
    rows = events.filter(F.col("type") == kind)
    return rows.select(f"{kind}.*") if kind in events.columns else rows


def with_event_time(df: DataFrame, delay: str = "0 seconds", column: str = "ts") -> DataFrame:
    """A watermark on the event time; naive timestamps are read in the session's zone first. No effect in batch."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)
