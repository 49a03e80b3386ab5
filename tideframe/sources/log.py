"""The record log: rows, the read-committed filter, seeks and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType())]), False)

#: The columns that every log table has, whatever its records hold.
FIXED = T.StructType(
    [
        T.StructField("_kafka_partition", T.IntegerType(), False, {"id": 1}),
        T.StructField("_kafka_offset", T.LongType(), False, {"id": 2}),
        T.StructField("_kafka_timestamp", T.TimestampNTZType(), False, {"id": 3}),
        T.StructField("_kafka_key", T.BinaryType(), True, {"id": 4}),
        T.StructField("_kafka_headers", HEADERS, False, {"id": 5}),
        T.StructField("_kafka_value", T.BinaryType(), True, {"id": 6}),
    ]
)


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long")


def events_log(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The events table as log records: partition by event_id, JSON value, one header for purchases."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    header = F.struct(F.lit("type").alias("key"), F.encode("event_type", "UTF-8").alias("value"))
    none = F.array().cast(HEADERS)
    return e.select(
        F.pmod("event_id", F.lit(partitions)).cast("int").alias("_kafka_partition"),
        F.expr(f"event_id div {partitions}").alias("_kafka_offset"),
        F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz").alias("_kafka_timestamp"),
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("_kafka_key"),
        F.when(F.col("event_type") == "purchase", F.array(header)).otherwise(none).cast(HEADERS).alias("_kafka_headers"),
        F.encode("props", "UTF-8").alias("_kafka_value"),
    )


def record_bytes() -> Column:
    """Key, value and headers' sizes; null parts count as nothing."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    heads = F.aggregate("_kafka_headers", F.lit(0).cast("long"), lambda a, h: a + size(h["key"]) + size(h["value"]))
    return size(F.col("_kafka_key")) + size(F.col("_kafka_value")) + F.coalesce(heads, F.lit(0).cast("long"))


def spans(aborted: DataFrame, markers: DataFrame) -> DataFrame:
    """partition, producer, first, marker of aborted transactions.

    aborted(partition, producer, first) names first offsets; markers(partition, producer, offset) are
    abort markers: a transaction ends at its producer's next one. Without one it is still open."""
    none = F.lit(None).cast("long")
    both = aborted.select("partition", "producer", "first", F.col("first").alias("_at"), none.alias("_end")).unionByName(
        markers.select("partition", "producer", none.alias("first"), F.col("offset").alias("_at"), F.col("offset").alias("_end"))
    )
    # from the last offset down, the least marker so far is the next one: one pass over a producer's rows
    later = Window.partitionBy("partition", "producer").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("marker", F.min("_end").over(later)).where("first is not null").select("partition", "producer", "first", "marker")


def read_committed(batches: DataFrame, aborted: DataFrame, markers: DataFrame) -> DataFrame:
    """batches(partition, offset, producer, transactional, control, ...) without control records and
    without transactional records of aborted transactions. Offsets keep their gaps."""
    s = spans(aborted, markers).select(F.col("partition").alias("_p"), F.col("producer").alias("_r"), "first", "marker")
    data = batches.where(~F.col("control"))
    inside = (
        (data["partition"] == s["_p"]) & (data["producer"] == s["_r"]) & data["transactional"]
        & (data["offset"] >= s["first"]) & (s["marker"].isNull() | (data["offset"] < s["marker"]))
    )
    return data.join(s, inside, "left_anti")


def offset_at(records: DataFrame, ts: Column) -> DataFrame:
    """First offset of each partition at or after a time; partitions without one are absent."""
    return records.where(F.col("_kafka_timestamp") >= ts).groupBy("_kafka_partition").agg(F.min("_kafka_offset").alias("offset"))


def browse(records: DataFrame, partition: int, offset: int = 0, limit: int = 50, span: int = 10) -> DataFrame:
    """Up to limit (1 to 500) records of a partition from an offset on, out of span times as many offsets."""
    limit = min(max(limit, 1), 500)
    some = (F.col("_kafka_partition") == partition) & (F.col("_kafka_offset") >= offset) & (F.col("_kafka_offset") < offset + span * limit)
    return records.where(some).orderBy("_kafka_offset").limit(limit)
