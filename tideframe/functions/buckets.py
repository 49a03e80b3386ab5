"""Time buckets of log records as column expressions (UTC; floor division, also before 1970)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
GRANULARITIES = ("none", "hour", "day", "month")
_INT_MIN, _INT_MAX = -(1 << 31), (1 << 31) - 1


def floor_div(x: Column, by: int) -> Column:
    """x divided by a positive number, rounded down (a plain division would round toward zero)."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")


def bucket(ts_ms: Column, granularity: str) -> Column:
    """The record's bucket: hours or days since 1970, months as (year - 1970) * 12 + month - 1, or null."""
    if granularity == "none":
        return F.lit(None).cast("int")
    if granularity == "month":
        day = F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts_ms, DAY_MS).cast("int"))
        return ((F.year(day) - 1970) * 12 + F.month(day) - 1).cast("int")
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    whole = floor_div(ts_ms, HOUR_MS if granularity == "hour" else DAY_MS)
    return F.greatest(F.least(whole, F.lit(_INT_MAX).cast("long")), F.lit(_INT_MIN).cast("long")).cast("int")


def bucket_end_ms(bucket_no: Column, granularity: str) -> Column:
    """First millisecond behind the bucket; null where the bucket never ends."""
    if granularity == "none":
        return F.lit(None).cast("long")
    if granularity == "month":
        start = F.add_months(F.lit("1970-01-01").cast("date"), (bucket_no + 1).cast("int"))
        return F.datediff(start, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
    return (bucket_no.cast("long") + 1) * (HOUR_MS if granularity == "hour" else DAY_MS)


def bucket_ended(bucket_no: Column, granularity: str, before_ms: Column | int) -> Column:
    """Whether the bucket lies wholly before the given time."""
    before = before_ms if isinstance(before_ms, Column) else F.lit(before_ms)
    return F.coalesce(bucket_end_ms(bucket_no, granularity) <= before, F.lit(False))
