"""The test data seen as a log and its metadata, for the named queries; each frame beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.buckets import bucket
from tideframe.sources.log import events_log, millis, record_bytes

#: Offsets in a file's range; every fourth range ends a snapshot.
RANGE = 250


def records(spark: SparkSession, d: str) -> DataFrame:
    """p, o, ts, ms, k, v, sz: the log's records, bytes as text."""
    log = events_log(spark, d)
    return log.select(
        F.col("_kafka_partition").alias("p"), F.col("_kafka_offset").alias("o"), F.col("_kafka_timestamp").alias("ts"), millis(F.col("_kafka_timestamp")).alias("ms"),
        F.col("_kafka_key").cast("string").alias("k"), F.col("_kafka_value").cast("string").alias("v"), record_bytes().alias("sz"),
    )


LOG = """log as (select cast(event_id % 4 as int) as p, event_id // 4 as o, date_trunc('milliseconds', ts)::timestamp as ts, epoch_us(ts) // 1000 as ms,
    user_id::varchar as k, props as v, event_type as t,
    (length(user_id::varchar) + length(props) + case when event_type = 'purchase' then 12 else 0 end)::bigint as sz from events)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of files: one for each range and day; every third range was replaced at snapshot 3."""
    r = records(spark, d)
    top = r.groupBy("p").agg((F.max("o") + 1).alias("top"))
    g = r.withColumns({"bucket": bucket(F.col("ms"), "day"), "no": F.expr(f"o div {RANGE}")})
    g = g.groupBy("p", "no", "bucket").agg(F.count(F.lit(1)).alias("records"), F.sum("sz").alias("bytes"), F.min("ms").alias("first_ts_ms"))
    return g.join(F.broadcast(top), "p").select(
        F.lit(1).alias("topic_id"), F.col("p").alias("partition"), (F.col("no") * RANGE).alias("start"), F.least((F.col("no") + 1) * RANGE, F.col("top")).alias("end"),
        F.lit(0).alias("spec"), "bucket", F.lit(0).alias("schema"), "records", "bytes", "first_ts_ms", F.expr("no div 4 + 1").alias("added"),
        F.when(F.col("no") % 3 == 2, F.lit(3)).cast("long").alias("replaced"),
    )


FILES = f"""{LOG}, tops as (select p, max(o) + 1 as top from log group by p),
files as (select 1 as topic_id, p as partition, no * {RANGE} as start, least((no + 1) * {RANGE}, top) as "end", 0 as spec, bucket, 0 as schema, records, bytes, first_ts_ms,
    no // 4 + 1 as added, case when no % 3 = 2 then 3::bigint end as replaced
  from (select p, o // {RANGE} as no, cast(floor(ms / 86400000.0) as int) as bucket, count(*) as records, sum(sz)::bigint as bytes, min(ms) as first_ts_ms
        from log group by all) join tops using (p))"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """topic_id, id, committed_ms: one for each four ranges."""
    f = files(spark, d)
    return f.groupBy("topic_id", F.col("added").alias("id")).agg((F.max("first_ts_ms") + 1000).alias("committed_ms"))


def offsets(spark: SparkSession, d: str) -> DataFrame:
    """topic_id, id, partition, start, end: a snapshot's offsets run from 0 to its last file."""
    f = files(spark, d).groupBy("topic_id", "added", "partition").agg(F.max("end").alias("end"))
    return f.select("topic_id", F.col("added").alias("id"), "partition", F.lit(0).cast("long").alias("start"), "end")


SNAPSHOTS = f"""{FILES}, snapshots as (select topic_id, added as id, max(first_ts_ms) + 1000 as committed_ms from files group by all),
offsets as (select topic_id, added as id, partition, 0::bigint as start, max("end") as "end" from files group by all)"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Indexed ranges after a retention trim of the first two file ranges of even partitions."""
    f = files(spark, d).groupBy("topic_id", "partition").agg(F.max("end").alias("end"))
    return f.select("topic_id", "partition", F.when(F.col("partition") % 2 == 0, 2 * RANGE).otherwise(0).cast("long").alias("start"), "end")


RANGES = f"""{SNAPSHOTS}, ranges as (select topic_id, partition, case when partition % 2 = 0 then {2 * RANGE} else 0 end::bigint as start, max("end") as "end" from files group by topic_id, partition)"""


def topics(spark: SparkSession, d: str) -> DataFrame:
    """The nations as topics: state by key."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    state = F.when(F.col("n_nationkey") % 5 == 4, "removing").when(F.col("n_nationkey") % 5 == 3, "missing").otherwise("indexing")
    return n.select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("name"), state.alias("state"))


TOPICS = """topics as (select n_nationkey as topic_id, n_name as name,
    case when n_nationkey % 5 = 4 then 'removing' when n_nationkey % 5 = 3 then 'missing' else 'indexing' end as state from nation)"""


def batches(spark: SparkSession, d: str) -> DataFrame:
    """The log with producers: two of three records are transactional, every tenth error is an abort marker."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.pmod("event_id", F.lit(4)).cast("int").alias("partition"), F.expr("event_id div 4").alias("offset"), (F.col("user_id") % 5).alias("producer"),
        (F.col("event_id") % 3 != 0).alias("transactional"), ((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)).alias("control"),
    )


def transactions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Aborted transactions and their markers: one begins at the producer's first transactional record after the last marker."""
    b = batches(spark, d)
    markers = b.where("control").select("partition", "producer", "offset")
    w = Window.partitionBy("partition", "producer").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    turn = b.withColumn("turn", F.sum(F.col("control").cast("int")).over(w) - F.col("control").cast("int"))
    first = turn.where("transactional and not control").groupBy("partition", "producer", "turn").agg(F.min("offset").alias("first"))
    ended = turn.where("control").select("partition", "producer", "turn")
    return first.join(ended, ["partition", "producer", "turn"]).select("partition", "producer", "first"), markers


BATCHES = """batches as (select cast(event_id % 4 as int) as partition, event_id // 4 as "offset", user_id % 5 as producer, event_id % 3 <> 0 as transactional,
    event_type = 'error' and event_id % 10 = 0 as control from events)"""
