"""Single values as bytes, for statistics that other engines read."""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid

from pyspark.sql import types as T


def encoded(value, kind: T.DataType, logical: str | None = None) -> bytes | None:
    """Little-endian numbers, UTF-8 text, big-endian decimals of least length, days and microseconds."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return b"\1" if value else b"\0"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return struct.pack("<i", value)
    if isinstance(kind, T.LongType):
        return struct.pack("<q", value)
    if isinstance(kind, T.FloatType):
        return struct.pack("<f", value)
    if isinstance(kind, T.DoubleType):
        return struct.pack("<d", value)
    if isinstance(kind, T.DateType):
        return struct.pack("<i", (value - dt.date(1970, 1, 1)).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zero = dt.datetime(1970, 1, 1, tzinfo=value.tzinfo and dt.timezone.utc)
        return struct.pack("<q", (value - zero) // dt.timedelta(microseconds=1))
    if isinstance(kind, T.DecimalType):
        n = int(decimal.Decimal(value).scaleb(kind.scale))
        return n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)
    if isinstance(kind, T.StringType):
        return uuid.UUID(value).bytes if logical == "uuid" else value.encode()
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    raise TypeError(f"no single-value form of {kind.simpleString()}")


def connector_type(kind: T.DataType, logical: str | None = None) -> str:
    """The type that a connector without the log's own types shows for a column."""
    if logical == "uuid":
        return "varchar"
    if logical == "time":
        return "bigint"
    plain = {
        T.BooleanType: "bit", T.IntegerType: "int", T.LongType: "bigint", T.FloatType: "float4", T.DoubleType: "float8", T.StringType: "varchar",
        T.BinaryType: "varbinary", T.DateType: "dateday", T.TimestampType: "timestampmilli utc", T.TimestampNTZType: "datemilli",
    }
    if type(kind) in plain:
        return plain[type(kind)]
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{f.name}: {connector_type(f.dataType, f.metadata.get('logical'))}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"list<{connector_type(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{connector_type(kind.keyType)}, {connector_type(kind.valueType)}>"
    raise TypeError(kind.simpleString())
