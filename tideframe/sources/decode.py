"""Payload decoders: Avro, JSON Schema and Protobuf bytes to typed columns.

A payload is decoded whole or not at all: whatever does not fit leaves the part as raw bytes. The
decoders run on Arrow batches; Spark has no built-in expression with these semantics.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
import struct
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_EPOCH = dt.datetime(1970, 1, 1)
_UTC = dt.timezone.utc


class Undecodable(ValueError):
    """The payload is not one of the schema."""


def compact(value, ordered: bool = False) -> str:
    """Compact JSON; ordered sorts members at every depth."""
    return json.dumps(value, separators=(",", ":"), sort_keys=ordered, ensure_ascii=False)


# -- Avro -------------------------------------------------------------------------------------------


class _Reader:
    __slots__ = ("data", "at")

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Undecodable("short payload")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
            if shift > 63:
                raise Undecodable("long number")

    def long(self) -> int:
        v = self.varint()
        return (v >> 1) ^ -(v & 1)


class Avro:
    """Decoder and column types of an Avro schema (as parsed JSON)."""

    def __init__(self, schema) -> None:
        self.named: dict[str, object] = {}
        self.schema = self._register(schema, "")

    def _register(self, s, space: str):
        if isinstance(s, list):
            return [self._register(x, space) for x in s]
        if isinstance(s, str):
            return s if s in _AVRO_PLAIN or "." in s or not space else (f"{space}.{s}" if f"{space}.{s}" in self.named else s)
        kind = s["type"]
        if isinstance(kind, (dict, list)):
            return self._register(kind, space)
        out = dict(s)
        if kind in ("record", "enum", "fixed"):
            space = s.get("namespace", space if "." not in s["name"] else s["name"].rpartition(".")[0])
            out["full"] = s["name"] if "." in s["name"] or not space else f"{space}.{s['name']}"
            self.named[out["full"]] = self.named[s["name"]] = out
        if kind == "record":
            out["fields"] = [{**f, "type": self._register(f["type"], space)} for f in s["fields"]]
        elif kind == "array":
            out["items"] = self._register(s["items"], space)
        elif kind == "map":
            out["values"] = self._register(s["values"], space)
        return out

    def _of(self, s):
        return self.named.get(s, s) if isinstance(s, str) else s

    def column_type(self, s=None, within: tuple = ()) -> T.DataType:
        """The Spark type of a schema; what has none is a string that holds compact JSON."""
        s = self._of(self.schema if s is None else s)
        if isinstance(s, list):
            rest = [x for x in s if x != "null"]
            return self.column_type(rest[0], within) if len(s) == 2 and len(rest) == 1 else T.StringType()
        kind = s if isinstance(s, str) else s["type"]
        logical = None if isinstance(s, str) else s.get("logicalType")
        if kind == "record":
            if s["full"] in within or within and self._recursive(s, s["full"], ()):
                return T.StringType()
            inner = [T.StructField(f["name"], self.column_type(f["type"], (*within, s["full"])), True, {"identity": f["name"], "aliases": f.get("aliases", [])}) for f in s["fields"]]
            return T.StructType(inner)
        if kind == "array":
            return T.ArrayType(self.column_type(s["items"], within), True)
        if kind == "map":
            return T.MapType(T.StringType(), self.column_type(s["values"], within), True)
        if kind in ("bytes", "fixed"):
            if logical == "decimal":
                return T.DecimalType(s["precision"], s.get("scale", 0)) if s["precision"] <= 38 else T.StringType()
            return T.StringType() if logical in ("big-decimal",) else T.BinaryType()
        if kind == "long" and logical in ("timestamp-millis", "timestamp-micros"):
            return T.TimestampType()
        if kind == "long" and logical in ("local-timestamp-millis", "local-timestamp-micros"):
            return T.TimestampNTZType()
        if logical in ("time-millis", "time-micros"):
            return T.LongType()
        if kind == "int" and logical == "date":
            return T.DateType()
        return _AVRO_PLAIN.get(kind, T.StringType())

    def _recursive(self, s, full: str, seen: tuple) -> bool:
        s = self._of(s)
        if isinstance(s, list):
            return any(self._recursive(x, full, seen) for x in s)
        if isinstance(s, str):
            return False
        if s["type"] == "record":
            if s["full"] in seen:
                return s["full"] == full
            return any(self._recursive(f["type"], full, (*seen, s["full"])) for f in s["fields"])
        return self._recursive(s.get("items", s.get("values", "null")), full, seen) if s["type"] in ("array", "map") else False

    def decode(self, data: bytes):
        """The payload's value; all of it must be used."""
        r = _Reader(data)
        value = self._read(r, self.schema, self.column_type())
        if r.at != len(data):
            raise Undecodable("bytes left over")
        return value

    def _read(self, r: _Reader, s, to: T.DataType | None):
        s = self._of(s)
        if isinstance(s, list) and len(s) == 2 and "null" in s:
            k = r.long()
            if not 0 <= k < len(s):
                raise Undecodable("no such branch")
            return None if s[k] == "null" else self._read(r, s[k], to)
        if isinstance(to, T.StringType) and self._as_json(s):
            return compact(self._json(r, s))
        kind = s if isinstance(s, str) else s["type"]
        logical = None if isinstance(s, str) else s.get("logicalType")
        if kind == "record":
            return {f["name"]: self._read(r, f["type"], to[f["name"]].dataType) for f in s["fields"]}
        if kind == "array":
            return [self._read(r, s["items"], to.elementType) for _ in self._blocks(r)]
        if kind == "map":
            return [(r.take(r.long()).decode(), self._read(r, s["values"], to.valueType)) for _ in self._blocks(r)]
        v = self._plain(r, s, kind)
        if logical == "decimal":
            n = decimal.Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-s.get("scale", 0))
            if len(n.as_tuple().digits) > s["precision"]:
                raise Undecodable("decimal too wide")
            return n
        if logical == "date":
            return dt.date(1970, 1, 1) + dt.timedelta(days=v)
        if logical == "time-millis":
            return v * 1000
        if logical in ("timestamp-millis", "timestamp-micros"):
            return (_EPOCH + dt.timedelta(microseconds=v * (1000 if logical.endswith("millis") else 1))).replace(tzinfo=_UTC)
        if logical in ("local-timestamp-millis", "local-timestamp-micros"):
            return _EPOCH + dt.timedelta(microseconds=v * (1000 if logical.endswith("millis") else 1))
        if logical == "uuid" and isinstance(v, str):
            return str(uuid.UUID(v))
        return v

    def _as_json(self, s) -> bool:
        """Whether a schema whose column is a string is written there as JSON."""
        s = self._of(s)
        if isinstance(s, list):
            return True
        kind = s if isinstance(s, str) else s["type"]
        return kind in ("record", "array", "map", "null", "bytes", "fixed")

    def _blocks(self, r: _Reader):
        while n := r.long():
            if n < 0:
                r.long()
                n = -n
            if n > len(r.data) + 65_536:
                raise Undecodable("too many items")
            yield from range(n)

    def _plain(self, r: _Reader, s, kind):
        try:
            if kind == "null":
                return None
            if kind == "boolean":
                return {0: False, 1: True}[r.take(1)[0]]
            if kind in ("int", "long"):
                v = r.long()
                if kind == "int" and not -(1 << 31) <= v < 1 << 31:
                    raise Undecodable("int out of range")
                return v
            if kind == "float":
                return struct.unpack("<f", r.take(4))[0]
            if kind == "double":
                return struct.unpack("<d", r.take(8))[0]
            if kind == "bytes":
                return r.take(r.long())
            if kind == "string":
                return r.take(r.long()).decode()
            if kind == "fixed":
                return r.take(s["size"])
            if kind == "enum":
                return s["symbols"][_index(r.long())]
        except (KeyError, IndexError, UnicodeDecodeError) as e:
            raise Undecodable(str(e)) from e
        raise Undecodable(f"unknown type {kind}")

    def _json(self, r: _Reader, s):
        """The value as JSON: fields in schema order, branches named, bytes as Latin-1."""
        s = self._of(s)
        if isinstance(s, list):
            k = r.long()
            if not 0 <= k < len(s):
                raise Undecodable("no such branch")
            b = self._of(s[k])
            if b == "null":
                return None
            return {(b if isinstance(b, str) else b.get("full", b["type"])): self._json(r, b)}
        kind = s if isinstance(s, str) else s["type"]
        if kind == "record":
            return {f["name"]: self._json(r, f["type"]) for f in s["fields"]}
        if kind == "array":
            return [self._json(r, s["items"]) for _ in self._blocks(r)]
        if kind == "map":
            return {r.take(r.long()).decode(): self._json(r, s["values"]) for _ in self._blocks(r)}
        v = self._plain(r, s, kind)
        if isinstance(v, bytes):
            return v.decode("latin-1")
        return str(v) if isinstance(v, float) and not math.isfinite(v) else v


_AVRO_PLAIN = {
    "null": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(),
}


def _index(k: int) -> int:
    if k < 0:
        raise IndexError(k)
    return k


# -- JSON Schema ------------------------------------------------------------------------------------

_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


class JsonSchema:
    """Decoder and column types of a JSON Schema (as parsed JSON)."""

    def __init__(self, schema: dict, others: dict[str, dict] | None = None) -> None:
        self.root, self.others = schema, others or {}

    def _of(self, s: dict) -> dict:
        while "$ref" in s:
            name, _, inner = s["$ref"].partition("#")
            at = self.others[name] if name else self.root
            for key in filter(None, inner.split("/")):
                at = at[key]
            s = at
        return s

    def _kind(self, s: dict) -> tuple[str, dict]:
        """A schema's type once a null beside it is left out; 'json' for what has no column type."""
        s = self._of(s)
        for key in ("oneOf", "anyOf"):
            if key in s:
                rest = [x for x in s[key] if self._of(x).get("type") != "null"]
                return self._kind(rest[0]) if len(rest) == 1 and len(s[key]) == 2 else ("json", s)
        kinds = s.get("type")
        if isinstance(kinds, list):
            rest = [k for k in kinds if k != "null"]
            kinds = rest[0] if len(rest) == 1 else None
        if "allOf" in s or kinds is None or kinds == "null" or "prefixItems" in s:
            return "json", s
        return kinds, s

    def column_type(self, s: dict | None = None, within: tuple = ()) -> T.DataType:
        kind, s = self._kind(self.root if s is None else s)
        if id(s) in within:
            return T.StringType()
        if kind == "object":
            if "properties" in s:
                if self._recursive(s, s, ()):
                    return T.StringType()
                return T.StructType([T.StructField(k, self.column_type(v, (*within, id(s))), True, {"identity": k}) for k, v in s["properties"].items()])
            extra = s.get("additionalProperties")
            return T.MapType(T.StringType(), self.column_type(extra, (*within, id(s)))) if isinstance(extra, dict) else T.StringType()
        if kind == "array" and isinstance(s.get("items"), dict):
            return T.ArrayType(self.column_type(s["items"], (*within, id(s))), True)
        if kind == "string":
            return {"date-time": T.TimestampType(), "date": T.DateType()}.get(s.get("format"), T.StringType())
        return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())

    def _recursive(self, s: dict, target: dict, seen: tuple) -> bool:
        s = self._of(s)
        if id(s) in seen:
            return s is target
        inner = [*s.get("properties", {}).values(), *s.get("oneOf", ()), *s.get("anyOf", ()), *(x for x in (s.get("items"), s.get("additionalProperties")) if isinstance(x, dict))]
        return any(self._recursive(x, target, (*seen, id(s))) for x in inner)

    def decode(self, data: bytes):
        try:
            value = json.loads(data)
        except (ValueError, RecursionError) as e:
            raise Undecodable(str(e)) from e
        return self._fit(value, self.root, self.column_type())

    def _fit(self, v, s: dict, to: T.DataType):
        if v is None:
            return None
        kind, s = self._kind(s)
        wrong = Undecodable(f"not {kind}")
        if isinstance(to, T.StructType):
            if not isinstance(v, dict):
                raise wrong
            return {f.name: self._fit(v.get(f.name), s["properties"][f.name], f.dataType) for f in to.fields}
        if isinstance(to, T.MapType):
            if not isinstance(v, dict):
                raise wrong
            return [(k, self._fit(v[k], s["additionalProperties"], to.valueType)) for k in sorted(v)]
        if isinstance(to, T.ArrayType):
            if not isinstance(v, list):
                raise wrong
            return [self._fit(x, s["items"], to.elementType) for x in v]
        if kind in ("json", "object", "array"):
            return compact(v, True)
        if kind == "integer":
            if isinstance(v, bool) or not isinstance(v, int) or not -(1 << 63) <= v < 1 << 63:
                raise wrong
            return v
        if kind == "number":
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise wrong
            return float(v)
        if kind == "boolean":
            if not isinstance(v, bool):
                raise wrong
            return v
        if not isinstance(v, str):
            raise wrong
        try:
            if isinstance(to, T.TimestampType):
                return rfc3339(v)
            if isinstance(to, T.DateType):
                return dt.date.fromisoformat(v)
            return str(uuid.UUID(v)) if s.get("format") == "uuid" else v
        except ValueError as e:
            raise Undecodable(str(e)) from e


def rfc3339(text: str) -> dt.datetime:
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"not a time: {text}")
    micros = int(((m[7] or ".")[1:] + "000000")[:6])
    zone = 0 if m[8] in "Zz" else (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 60 + int(m[8][4:6]))
    t = dt.datetime(*(int(m[k]) for k in range(1, 7)), micros)
    return (t - dt.timedelta(minutes=zone)).replace(tzinfo=_UTC)


# -- Protobuf ---------------------------------------------------------------------------------------

_SCALAR = {
    1: T.DoubleType(), 2: T.FloatType(), 3: T.LongType(), 4: T.DecimalType(20, 0), 5: T.IntegerType(), 6: T.DecimalType(20, 0), 7: T.LongType(),
    8: T.BooleanType(), 9: T.StringType(), 12: T.BinaryType(), 13: T.LongType(), 14: T.StringType(), 15: T.IntegerType(), 16: T.LongType(),
    17: T.IntegerType(), 18: T.LongType(),
}
_JSON_MESSAGES = {f"google.protobuf.{x}" for x in ("Any", "Struct", "Value", "ListValue", "Duration", "FieldMask", "Empty")}
_WRAPPERS = {f"google.protobuf.{x}Value" for x in ("Double", "Float", "Int64", "UInt64", "Int32", "UInt32", "Bool", "String", "Bytes")}


class Protobuf:
    """Decoder and column types of a message, from a serialized FileDescriptorSet."""

    def __init__(self, descriptors: bytes, message: str) -> None:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

        pool = descriptor_pool.DescriptorPool()
        for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
            pool.Add(f)
        self.message = pool.FindMessageTypeByName(message)
        self.make = message_factory.GetMessageClass(self.message)

    def column_type(self, m=None, within: tuple = ()) -> T.DataType:
        m = m or self.message
        return T.StructType([T.StructField(f.name, self._field_type(f, (*within, m.full_name)), True, {"identity": f.number}) for f in m.fields])

    def _field_type(self, f, within: tuple) -> T.DataType:
        if f.message_type and f.message_type.GetOptions().map_entry:
            return T.MapType(T.StringType(), self._one(f.message_type.fields_by_name["value"], within), True)
        return T.ArrayType(self._one(f, within), True) if f.is_repeated else self._one(f, within)

    def _one(self, f, within: tuple) -> T.DataType:
        m = f.message_type
        if m is None:
            return _SCALAR[f.type]
        if m.full_name == "google.protobuf.Timestamp":
            return T.TimestampType()
        if m.full_name in _WRAPPERS:
            return _SCALAR[m.fields_by_name["value"].type]
        if m.full_name in _JSON_MESSAGES or m.full_name in within or self._recursive(m, m, ()):
            return T.StringType()
        return self.column_type(m, within)

    def _recursive(self, m, target, seen: tuple) -> bool:
        if m.full_name in seen:
            return m.full_name == target.full_name
        return any(self._recursive(f.message_type, target, (*seen, m.full_name)) for f in m.fields if f.message_type)

    def decode(self, data: bytes, indexed: bool = True):
        """The message behind its index (a list of numbers, [0] written as one zero)."""
        from google.protobuf.message import DecodeError

        if indexed:
            r = _Reader(data)
            n = r.long()
            path = [r.long() for _ in range(n)] if n else [0]
            data = data[r.at :]
            if path != self._index():
                raise Undecodable("another message of the schema")
        m = self.make()
        try:
            m.ParseFromString(data)
        except DecodeError as e:
            raise Undecodable(str(e)) from e
        return self._value(m, self.column_type())

    def _index(self) -> list[int]:
        """The message's place in its file, from the outermost message in."""
        m, path = self.message, []
        while m:
            around = m.containing_type.nested_types if m.containing_type else m.file.message_types_by_name.values()
            path.insert(0, [x.full_name for x in around].index(m.full_name))
            m = m.containing_type
        return path

    def _value(self, m, to: T.StructType) -> dict:
        out = {}
        for f in m.DESCRIPTOR.fields:
            kind = to[f.name].dataType
            if f.message_type and f.message_type.GetOptions().map_entry:
                entry = f.message_type.fields_by_name["value"]
                found = getattr(m, f.name)
                keys = sorted(found, key=str)
                out[f.name] = [(str(k).lower() if isinstance(k, bool) else str(k), self._scalar(entry, found[k], kind.valueType)) for k in keys]
            elif f.is_repeated:
                out[f.name] = [self._scalar(f, x, kind.elementType) for x in getattr(m, f.name)]
            else:
                out[f.name] = None if f.has_presence and not m.HasField(f.name) else self._scalar(f, getattr(m, f.name), kind)
        return out

    def _scalar(self, f, v, to: T.DataType):
        from google.protobuf import json_format

        if f.message_type:
            name = f.message_type.full_name
            if name == "google.protobuf.Timestamp":
                return (_EPOCH + dt.timedelta(seconds=v.seconds, microseconds=v.nanos // 1000)).replace(tzinfo=_UTC)
            if name in _WRAPPERS:
                return self._scalar(f.message_type.fields_by_name["value"], v.value, to)
            return self._value(v, to) if isinstance(to, T.StructType) else compact(json_format.MessageToDict(v, preserving_proto_field_name=True), True)
        if f.enum_type:
            known = f.enum_type.values_by_number.get(v)
            return known.name if known else str(v)
        return decimal.Decimal(v) if isinstance(to, T.DecimalType) else v


# -- columns ----------------------------------------------------------------------------------------


def decoded(df: DataFrame, column: str, decoder: Callable[[], object]) -> DataFrame:
    """df with ``decoded`` (the payload's columns) and ``raw`` (the bytes that could not be decoded).

    decoder() makes an Avro, JsonSchema or Protobuf object; it is called once in the driver and once
    for each task. Null bytes give null in both; of decoded and raw at most one is set."""
    kind = decoder().column_type()
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", kind), T.StructField("raw", T.BinaryType())])
    arrow = to_arrow_type(kind)
    at = df.columns.index(column)

    def run(batches):
        d = decoder()
        for batch in batches:
            values, raw = [], []
            for b in batch.column(at).to_pylist():
                try:
                    v, r = (None, None) if b is None else (d.decode(bytes(b)), None)
                    pa.array([v], arrow)  # a value that does not fit its column counts as undecodable
                except (Undecodable, pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, ValueError, RecursionError):
                    v, r = None, b
                values.append(v)
                raw.append(r)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow), pa.array(raw, pa.binary())], schema.fieldNames())

    return df.mapInArrow(run, schema)


def routed(df: DataFrame, column: str, known: list[str], schema_id: str = "schema_id") -> DataFrame:
    """df with ``route``: null, raw or columns; an id that was never merged is an error, not raw."""
    c, s = F.col(column), F.col(schema_id)
    unknown = F.raise_error(F.concat(F.lit("schema was never merged: "), s)).cast("string")
    route = F.when(c.isNull(), "null").when(s.isNull(), "raw").when(s.isin(known), "columns").otherwise(unknown)
    return df.withColumn("route", route)


