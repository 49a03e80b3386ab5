"""Evolving table schemas: merging a writer's fields into a table, and reading old data under a new schema.

A field carries ``id`` (never changes) and ``identity`` (what the writer's schema language identifies
it by: a name or alias, a number) in its metadata. Schemas only grow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.sources.log import FIXED

FIRST_ID = 10
RESERVED = frozenset(FIXED.fieldNames()) | {"_kafka_decoded_key"}
MOST_FIELDS, MOST_DEPTH = 10_000, 64


@dataclass(frozen=True)
class Rejected:
    """Why records of a schema stay as they are: missing, other_registry, not_accepted, unsupported or reserved_name."""

    reason: str
    detail: str = ""


def field(name: str, kind: T.DataType, identity: str | int | None = None, aliases: tuple[str, ...] = ()) -> T.StructField:
    """A writer's field."""
    return T.StructField(name, kind, True, {"identity": name if identity is None else identity, "aliases": list(aliases)})


def widened(old: T.DataType, new: T.DataType) -> T.DataType | None:
    """The type that holds both without loss by promotion, or None."""
    if old == new:
        return old
    pair = (type(old), type(new))
    for narrow, wide in ((T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)):
        if pair in ((narrow, wide), (wide, narrow)):
            return wide()
    if pair == (T.DecimalType, T.DecimalType) and old.scale == new.scale:
        return old if old.precision >= new.precision else new
    return None


def _size(kind: T.DataType, depth: int = 0) -> tuple[int, int]:
    """Fields and greatest depth within a type."""
    inner = kind.fields if isinstance(kind, T.StructType) else ()
    parts = [f.dataType for f in inner]
    parts += [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
    found = [_size(p, depth + 1) for p in parts]
    return len(parts) + sum(n for n, _ in found), max([depth, *(d for _, d in found)])


class _Ids:
    def __init__(self, first: int) -> None:
        self.next = first

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def highest_id(schema: T.StructType) -> int:
    found = [FIRST_ID - 1]

    def walk(kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                found.append(f.metadata.get("id", 0))
                walk(f.dataType)
                found.extend(v for k, v in f.metadata.items() if k in ("element_id", "key_id", "value_id"))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType)

    walk(schema)
    return max(found)


def _numbered(fields: list[T.StructField], ids: _Ids) -> list[T.StructField]:
    """New fields with ids, breadth first: a struct's fields come after those beside it."""
    own = [(f, ids.take()) for f in fields]
    out = []
    for f, i in own:
        meta = {**f.metadata, "id": i}
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            meta["element_id"] = ids.take()
            if isinstance(kind.elementType, T.StructType):
                kind = T.ArrayType(T.StructType(_numbered(kind.elementType.fields, ids)), True)
        elif isinstance(kind, T.MapType):
            meta["key_id"], meta["value_id"] = ids.take(), ids.take()
            if isinstance(kind.valueType, T.StructType):
                kind = T.MapType(kind.keyType, T.StructType(_numbered(kind.valueType.fields, ids)), True)
        elif isinstance(kind, T.StructType):
            kind = T.StructType(_numbered(kind.fields, ids))
        out.append(T.StructField(f.name, kind, True, meta))
    return out


def _merged(table: list[T.StructField], writer: list[T.StructField], schema_id: int, ids: _Ids) -> list[T.StructField]:
    out = list(table)
    fresh = []
    for w in writer:
        names = {w.metadata.get("identity", w.name), *w.metadata.get("aliases", ())}
        at = next((i for i, f in enumerate(out) if f.metadata.get("identity", f.name) in names and not f.metadata.get("retired")), None)
        if at is None:
            fresh.append(w)
            continue
        f = out[at]
        if isinstance(f.dataType, T.StructType) and isinstance(w.dataType, T.StructType):
            kind: T.DataType | None = T.StructType(_merged(f.dataType.fields, w.dataType.fields, schema_id, ids))
        else:
            kind = widened(f.dataType, w.dataType)
        if kind is None:  # the old column steps aside, the new one takes its name
            out[at] = T.StructField(f"{f.name}_s{schema_id}", f.dataType, True, {**f.metadata, "retired": True})
            fresh.append(w)
        else:
            out[at] = T.StructField(w.name, kind, True, {**f.metadata, "identity": w.metadata.get("identity", w.name)})
    taken = {f.name for f in out}
    for f in _numbered(fresh, ids):
        name = f.name
        while name in taken:
            name = f"{name}_s{schema_id}"
        taken.add(name)
        out.append(T.StructField(name, f.dataType, True, f.metadata))
    return out


def merge(table: T.StructType, writer: T.StructType, schema_id: int) -> T.StructType | Rejected:
    """The table's schema (without the fixed columns) with the writer's fields merged in as version schema_id."""
    if any(f.name in RESERVED for f in writer.fields):
        return Rejected("reserved_name", ", ".join(f.name for f in writer.fields if f.name in RESERVED))
    count, depth = _size(writer)
    if count > MOST_FIELDS or depth > MOST_DEPTH:
        return Rejected("unsupported", f"{count} fields, depth {depth}")
    return T.StructType(_merged(table.fields, writer.fields, schema_id, _Ids(highest_id(table) + 1)))


def projected(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns under another version of its schema: found by field id, promoted, null where missing."""
    by_id = {f.metadata["id"]: f for f in df.schema.fields if "id" in f.metadata}

    def read(c: Column, old: T.DataType, new: T.DataType) -> Column:
        if not isinstance(new, T.StructType) or not isinstance(old, T.StructType):
            return c if old == new else c.cast(new)
        inner = {f.metadata.get("id", f.name): f for f in old.fields}
        parts = []
        for f in new.fields:
            o = inner.get(f.metadata.get("id", f.name))
            parts.append((read(c.getField(o.name), o.dataType, f.dataType) if o else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts))

    out = []
    for f in schema.fields:
        old = by_id.get(f.metadata.get("id"))
        c = read(df[f"`{old.name}`"], old.dataType, f.dataType) if old else F.lit(None).cast(f.dataType)
        out.append(c.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def read_versions(parts: list[DataFrame], schema: T.StructType) -> DataFrame:
    """Data of several schema versions under one schema."""
    out = projected(parts[0], schema)
    for p in parts[1:]:
        out = out.unionByName(projected(p, schema))
    return out


def widened_columns(old: T.StructType, new: T.StructType) -> T.StructType:
    """One schema for files of both, by name: new columns come last, and a type may only widen."""
    wide = [(T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType())]
    out = {f.name: f for f in old}
    for f in new:
        held = out.get(f.name)
        if held is None or (held.dataType, f.dataType) in wide:
            out[f.name] = T.StructField(f.name, f.dataType, True, f.metadata)
        elif held.dataType != f.dataType and (f.dataType, held.dataType) not in wide:
            raise ValueError(f"column {f.name!r} changes from {held.dataType.simpleString()} to {f.dataType.simpleString()}")
    return T.StructType(list(out.values()))


class Registry:
    """Schemas by id. Under a subject's rule a schema counts for a topic only if registered for it."""

    def __init__(self) -> None:
        self.schemas: dict[str, T.StructType] = {}
        self.references: dict[str, list[str]] = {}
        self.subjects: dict[str, set[str]] = {}

    def add(self, schema_id: str, schema: T.StructType, subject: str | None = None, references: list[str] | None = None) -> None:
        self.schemas.setdefault(schema_id, schema)
        self.references.setdefault(schema_id, list(references or []))
        if subject:
            self.subjects.setdefault(subject, set()).add(schema_id)

    def resolve(self, schema_id: str, topic: str, part: str = "value") -> T.StructType | Rejected:
        todo, seen = [schema_id], set()
        while todo:  # a schema counts only with all that it refers to
            x = todo.pop()
            if x not in self.schemas:
                return Rejected("missing", x)
            if x not in seen:
                seen.add(x)
                todo += self.references[x]
        if schema_id not in self.subjects.get(f"{topic}-{part}", set()):
            return Rejected("not_accepted", schema_id)
        return self.schemas[schema_id]
