"""Values as text for browsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 4096


def rendered(c: Column, kind: T.DataType) -> Column:
    """The value as text: whole numbers and decimals in digits, bytes as UTF-8 or else base64 (cut at
    4 KiB), dates and times in ISO form, structures as JSON, null as null."""
    if isinstance(kind, T.BinaryType):
        cut = F.substring(c, 1, MOST_BYTES)
        return F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(F.base64(cut))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if isinstance(kind, T.TimestampNTZType) else F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def hash_id(parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of text."""
    return F.substring(F.sha2(parts, 256), 1, 16)


def upper_bound(text: Column, length: int = 16) -> Column:
    """text, or where it is longer its first characters, the last of them that can be raised raised
    and those behind it cut; null where none can be raised."""
    out = F.lit(None).cast("string")
    for k in range(1, length + 1):
        point = _code_point(F.substring(text, k, 1))
        following = F.when(point == 0xD7FF, F.lit(0xE000)).otherwise(point + 1)
        out = F.when(point < 0x10FFFF, F.concat(F.substring(text, 1, k - 1), _character(following))).otherwise(out)
    return F.when(F.length(text) <= length, text).otherwise(out)


def _code_point(c: Column) -> Column:
    """Code point of a one-character text, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def lower_bound(text: Column, length: int = 16) -> Column:
    return F.substring(text, 1, length)
