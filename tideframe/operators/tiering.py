"""Writing history: partition transforms, sort order, file properties, position deletes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("zstd", "gzip", "brotli", "snappy", "lz4", "none")
_TERM = re.compile(r"(?:(\w+)\((?:(\d+)\s*,\s*)?([\w.]+)\)|([\w.]+))(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?", re.I)


@dataclass(frozen=True)
class Term:
    """transform(width, column) with, in sort orders, direction and place of nulls."""

    column: str
    transform: str = "identity"
    width: int | None = None
    descending: bool = False
    nulls_first: bool = True

    @staticmethod
    def parse(text: str) -> Term:
        m = _TERM.fullmatch(text.strip())
        if not m:
            raise ValueError(f"not a term: {text!r}")
        descending = (m[5] or "").lower() == "desc"
        first = m[6].lower() == "first" if m[6] else not descending
        return Term(m[3] or m[4], (m[1] or "identity").lower(), int(m[2]) if m[2] else None, descending, first)

    def name(self) -> str:
        plain = self.column.replace(".", "_")
        return plain if self.transform == "identity" else f"{plain}_{self.transform}"

    def value(self, schema: T.StructType) -> Column:
        """The term's partition value."""
        c, kind = F.col(self.column), schema[self.column].dataType if self.column in schema.fieldNames() else None
        day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
        if self.transform == "identity":
            return c
        if self.transform == "bucket":  # any stable hash would do; this one is Spark's own
            return F.when(c.isNotNull(), F.pmod(F.hash(c), F.lit(self.width)))
        if self.transform == "truncate":
            if isinstance(kind, T.StringType):
                return F.substring(c, 1, self.width)
            return (c - F.pmod(c, F.lit(self.width))).cast(kind)
        if self.transform == "day":
            return day
        if self.transform == "year":
            return F.year(c) - 1970
        if self.transform == "month":
            return (F.year(c) - 1970) * 12 + F.month(c) - 1
        if self.transform == "hour":
            return F.expr(f"cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{self.column}`) / 3600) as int)")
        if self.transform == "void":
            return F.lit(None).cast("int")
        raise ValueError(f"unknown transform {self.transform!r}")

    def order(self, schema: T.StructType) -> Column:
        c = self.value(schema)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def laid_out(df: DataFrame, partition: list[str], sort: list[str], splits: int = 1) -> DataFrame:
    """df with a column for each partition term, dealt out by them and sorted within.

    A partition value that holds most rows is spread over splits tasks by a hash of the row."""
    terms, orders = [Term.parse(t) for t in partition], [Term.parse(t) for t in sort]
    out = df
    for t in terms:
        out = out.withColumn(f"_part_{t.name()}", t.value(df.schema))
    names = [f"_part_{t.name()}" for t in terms]
    by = [F.col(n) for n in names]
    if splits > 1:
        by.append(F.pmod(F.xxhash64(*df.columns), F.lit(splits)))
    out = out.repartition(*by) if by else out
    order = [*names, *[t.order(df.schema) for t in orders]]
    return out.sortWithinPartitions(*order) if order else out


def write_options(codec: str = "zstd", level: int | None = None, group_bytes: int | None = None, page_bytes: int | None = None, bloom: tuple[str, ...] = (), rows_per_file: int | None = None) -> dict[str, str]:
    """Writer properties as options of Spark's Parquet sink."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    out = {"compression": "uncompressed" if codec == "none" else codec}
    if level is not None and codec == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(level)
    if group_bytes:
        out["parquet.block.size"] = str(group_bytes)
    if page_bytes:
        out["parquet.page.size"] = str(page_bytes)
    for c in bloom:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
    if rows_per_file:
        out["maxRecordsPerFile"] = str(rows_per_file)
    return out


def write_history(df: DataFrame, path: str, partition: list[str], sort: list[str], **properties) -> None:
    """Append rows to a history table's directory."""
    out = laid_out(df, partition, sort)
    names = [c for c in out.columns if c.startswith("_part_")]
    out.write.mode("append").options(**write_options(**properties)).partitionBy(*names).parquet(path)


def without_deleted(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows(file, pos, ...) less the positions in deletes(file, pos)."""
    return rows.join(deletes.select("file", "pos").distinct(), ["file", "pos"], "left_anti")


def check_history(schema: T.StructType, expected: T.StructType, version: int, spec_id: int, equality_deletes: int) -> None:
    """Refuse a history table that cannot be read beside the log."""
    if version != 2:
        raise ValueError(f"format version {version}")
    if [(f.name, f.dataType) for f in schema.fields] != [(f.name, f.dataType) for f in expected.fields]:
        raise ValueError("schema differs")
    if spec_id >= 1 << 30:
        raise ValueError("partition spec id out of range")
    if equality_deletes:
        raise ValueError("equality deletes are not supported")
