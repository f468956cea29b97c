"""JSON records to typed rows, to enriched rows, to serialised sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import avro_pair_hex
from ..functions.windows import with_windows
from ..schemas import ENTITY_JSON

NAMES = {"type": "type", "PK": "pk", "FK": "fk", "selectivityAttribute1": "sel1", "selectivityAttribute2": "sel2", "longAttribute1": "long1", "longAttribute2": "long2", "filterAttribute": "filter_attr", "plainString": "text"}


def parse_entities(envelopes: DataFrame, strict: bool = True) -> DataFrame:
    """Envelopes with a `json` column to entity columns; all others (id, time, mask) stay. Bad JSON fails, or is dropped without `strict`."""
    rows = envelopes.withColumn("record", F.from_json("json", ENTITY_JSON, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    if not strict:
        rows = rows.filter("record.type is not null")
    return rows.select(*[c for c in envelopes.columns if c != "json"], *[F.col(f"record.{a}").alias(b) for a, b in NAMES.items()])


def serialised_sums(df: DataFrame, ms: str, size: int, slide: int, key: str, value: str) -> DataFrame:
    """(window_start, key, total, payload): sums per window and key, and their Avro record in hex."""
    sums = with_windows(df, ms, size, slide).groupBy("window_start", F.col(key).alias("key")).agg(F.sum(value).alias("total"))
    return sums.withColumn("payload", avro_pair_hex(F.col("key"), F.col("total")))
