"""The star-schema and events tables seen as entities, auctions, bids and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are A, clicks B, purchases C; B refers to A by user, C to B by user modulo 50."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    e = events(spark, sf_dir).filter(kind.isin("view", "click", "purchase"))
    return e.select(
        F.when(kind == "view", "A").when(kind == "click", "B").otherwise("C").alias("type"), F.col("event_id").alias("id"), "ts", F.unix_millis("ts").alias("ms"),
        F.when(kind == "view", F.col("user_id")).when(kind == "click", F.col("event_id") % 50).otherwise(F.col("event_id")).alias("pk"),
        F.when(kind == "view", F.lit(-1)).when(kind == "click", F.col("user_id")).otherwise(F.col("user_id") % 50).cast("bigint").alias("fk"),
        (F.col("event_id") % 10).alias("sel1"), (F.col("user_id") % 10).alias("sel2"), (k % 20).cast("bigint").alias("long1"), F.round(F.col("value") * 100).cast("bigint").alias("long2"), k.alias("filter_attr"),
    )


def json_entity(entities: DataFrame) -> DataFrame:
    """Entities as an envelope (id, ts, ms) around a JSON payload."""
    names = {"type": "type", "pk": "PK", "fk": "FK", "sel1": "selectivityAttribute1", "sel2": "selectivityAttribute2", "long1": "longAttribute1", "long2": "longAttribute2", "filter_attr": "filterAttribute"}
    return entities.select("id", "ts", "ms", F.to_json(F.struct(*[F.col(a).alias(b) for a, b in names.items()])).alias("json"))


def auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    ms = millis("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("category"), F.expr("cast(round(o_totalprice * 100) as bigint) div 8").alias("reserve"), ms.alias("ms"), (ms + 365 * 86_400_000).alias("expires_ms"), (F.col("o_orderkey") % 10 == 0).alias("sell_below_reserve"))


def bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "lineitem")
    return b.select(F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"), millis("l_shipdate").alias("ms"), F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("extra"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


def telemetry(spark: SparkSession, sf_dir: str, step: int = 86_400_000) -> DataFrame:
    """(subtask, interval_ms, produced, consumed) per interval."""
    e = events(spark, sf_dir)
    ms = F.unix_millis("ts")
    return e.groupBy((F.col("event_id") % 4).alias("subtask"), (ms - F.pmod(ms, F.lit(step))).alias("interval_ms")).agg(F.count("*").alias("produced"), F.count(F.when(F.col("event_type") != "error", 1)).alias("consumed"))
