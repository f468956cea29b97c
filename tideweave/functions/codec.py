"""Avro's binary form of whole numbers, and JSON helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_hex(value: Column) -> Column:
    """Hex of a long as zig-zag varint: seven bits a byte, low bits first, the high bit set on all but the last."""
    zigzag = F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))
    part = lambda i: F.shiftrightunsigned(zigzag, 7 * i)
    out = None
    for i in range(9, -1, -1):
        low = part(i).bitwiseAND(F.lit(127).cast("bigint"))
        more = F.when(part(i + 1) != 0, F.lit(128)).otherwise(F.lit(0)) if i < 9 else F.lit(0)
        byte = F.lpad(F.hex((low + more).cast("bigint")), 2, "0")
        out = byte if out is None else F.when(part(i + 1) != 0, F.concat(byte, out)).otherwise(byte)
    return out


def avro_pair_hex(key: Column, total: Column) -> Column:
    """Hex of an Avro record of two longs (no file header)."""
    return F.concat(varint_hex(key), varint_hex(total))


def full_name(json: Column) -> Column:
    """firstName and lastName of a JSON object; an absent part reads `null`."""
    part = lambda k: F.coalesce(F.get_json_object(json, f"$.{k}"), F.lit("null"))
    return F.concat_ws(" ", part("firstName"), part("lastName"))
