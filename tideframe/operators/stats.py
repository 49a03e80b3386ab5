"""Statistics of columns by file: counts, bounds without NaN, and distinct-count sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.render import lower_bound, upper_bound

SKETCH_SIZE = 12
MODES = ("none", "counts", "truncate", "full")


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType, bool]]:
    """Path, type and whether it has bounds, of each leaf; structs are entered, lists and maps are leaves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, path + ".")
        else:
            out.append((path, f.dataType, not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType))))
    return out


def _bounded(c: Column, kind: T.DataType, mode: str, length: int) -> tuple[Column, Column]:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    low, high = F.min(c), F.max(c)
    if isinstance(kind, T.StringType) and mode == "truncate":
        low, high = lower_bound(low, length), upper_bound(high, length)
        # a bound that cannot be stated leaves both unstated
        low = F.when(high.isNotNull(), low)
    return low.cast("string"), high.cast("string")


def column_stats(df: DataFrame, by: list[str], columns: list[str] | None = None, mode: str = "truncate", length: int = 16) -> DataFrame:
    """One row for each group and leaf: rows, nulls, nans, lower, upper (as text, null where not stated).

    One aggregation over the data; the leaves are turned into rows behind it."""
    if mode not in MODES:
        raise ValueError(f"unknown metrics mode {mode!r}")
    some = [x for x in leaves(df.schema) if x[0] not in by and (columns is None or x[0] in columns)]
    measures = []
    for i, (path, kind, bounds) in enumerate(some):
        c = F.col(path)
        nans = F.count_if(F.isnan(c)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(None).cast("long")
        low = high = F.lit(None).cast("string")
        if bounds and mode in ("truncate", "full"):
            low, high = _bounded(c, kind, mode, length)
        nulls = F.count_if(c.isNull()) if mode != "none" else F.lit(None).cast("long")
        measures.append(
            F.struct(F.lit(path).alias("field"), F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), (nans if mode != "none" else F.lit(None).cast("long")).alias("nans"),
                     low.alias("lower"), high.alias("upper")).alias(f"_{i}")
        )
    wide = df.groupBy(*by).agg(*measures)
    return wide.select(*by, F.explode(F.array(*[f"_{i}" for i in range(len(some))])).alias("s")).select(*by, "s.*")


def merged_stats(stats: DataFrame, by: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Statistics of files put together: counts add up; bounds hold if every part with values has them.

    schema is that of the columns which stats(field, ...) describes: bounds are compared as values of
    the field's type. Bounds of a field that it does not hold are compared as text."""
    without = (F.col("lower").isNull() | F.col("upper").isNull()) & (F.col("rows") > F.coalesce("nulls", F.lit(0)) + F.coalesce("nans", F.lit(0)))
    of: dict[str, list[str]] = {}
    for path, kind, bounds in leaves(schema) if schema else []:
        if bounds and not isinstance(kind, T.StringType):
            of.setdefault(kind.simpleString(), []).append(path)
    low, high = F.min("lower"), F.max("upper")
    if of:
        typed = F.col("field").isin([x for paths in of.values() for x in paths])
        mine = {kind: F.col("field").isin(paths) for kind, paths in of.items()}
        low = F.coalesce(*[F.min(F.when(some, F.col("lower").cast(kind))).cast("string") for kind, some in mine.items()], F.min(F.when(~typed, F.col("lower"))))
        high = F.coalesce(*[F.max(F.when(some, F.col("upper").cast(kind))).cast("string") for kind, some in mine.items()], F.max(F.when(~typed, F.col("upper"))))
    unknown = F.bool_or(without)
    return stats.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("nans").alias("nans"), F.when(~unknown, low).alias("lower"), F.when(~unknown, high).alias("upper"),
    )


def file_bounds(schema: T.StructType, without: set[str]) -> tuple[Column, dict[str, str]]:
    """An aggregate: map of column to lower and upper bound (as text) that a scan may skip files by; and the columns' types.

    A column that holds NaN has no upper bound, since NaN compares above every number."""
    kinds = {f.name: f.dataType for f in schema.fields if f.name not in without and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.BooleanType))}
    parts = []
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        low, high = _bounded(c, kind, "truncate", 16)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            high = F.when(F.count_if(F.isnan(c)) == 0, high)
        parts += [F.lit(name), F.struct(low.alias("lower"), high.alias("upper"))]
    empty = F.lit(None).cast("map<string,struct<lower:string,upper:string>>")
    return F.create_map(*parts) if parts else F.any_value(empty), {n: k.simpleString() for n, k in kinds.items()}


def sketches(df: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """day, field, sketch of distinct values; nulls and empty bytes are left out.

    One aggregation over the data; the fields are turned into rows behind it."""
    def one(c: str) -> Column:
        kind = df.schema[c].dataType
        value = F.col(f"`{c}`")
        if isinstance(kind, T.BinaryType):
            value = F.when(F.octet_length(value) > 0, value)
        if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
            value = value.cast("string")
        # a day without a value has no sketch
        return F.when(F.count(value) > 0, F.struct(F.lit(c).alias("field"), F.theta_sketch_agg(value, SKETCH_SIZE).alias("sketch")))

    wide = df.groupBy(day.alias("day")).agg(*[one(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select("day", F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("s")).where("s is not null").select("day", "s.*")


def distinct_counts(sketched: DataFrame) -> DataFrame:
    """field and its estimated number of distinct values over all days."""
    return sketched.groupBy("field").agg(F.round(F.theta_sketch_estimate(F.theta_union_agg("sketch", SKETCH_SIZE))).cast("long").alias("ndv"))


def trimmed(sketched: DataFrame, earliest_day: Column) -> DataFrame:
    """Sketches of days from earliest_day on."""
    return sketched.where(F.col("day") >= earliest_day)
