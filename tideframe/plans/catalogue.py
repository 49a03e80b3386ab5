"""Named queries of the log-table engine, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideframe.functions import buckets, render, wire
from tideframe.functions.placement import owners
from tideframe.operators import grouping, planning, pruning, schema, stats, tiering
from tideframe.plans import control, demo
from tideframe.plans.demo import BATCHES, FILES, LOG, RANGE, RANGES, SNAPSHOTS, TOPICS
from tideframe.sources import log as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def named(sql: str | None = None):
    """Register a function under its name, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cents(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


# -- reading the log --------------------------------------------------------------------------------


@named(f"with {LOG} select count(*) as n, count(distinct k) as keys, min(ts) as first_ts, max(ts) as last_ts from log")
def log_counts(spark, d):
    log = source.events_log(spark, d)
    return log.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_kafka_key").alias("keys"), F.min("_kafka_timestamp").alias("first_ts"), F.max("_kafka_timestamp").alias("last_ts"))


@named(f"with {LOG} select * exclude (t) from log")
def log_records(spark, d):
    return demo.records(spark, d)


@named(f"""with {BATCHES}, b as (select *, coalesce(sum(control::int) over (partition by partition, producer order by "offset" rows between unbounded preceding and 1 preceding), 0) as turn from batches),
    a as (select partition, producer, turn, min("offset") as first from b where transactional and not control group by all),
    m as (select partition, producer, turn, "offset" as marker from b where control),
    s as (select * from a join m using (partition, producer, turn))
    select partition, "offset", producer, transactional from batches x where not control and not exists
      (select 1 from s where s.partition = x.partition and s.producer = x.producer and x.transactional and x."offset" >= s.first and x."offset" < s.marker)""")  # fmt: skip
def aborted_filtered(spark, d):
    aborted, markers = demo.transactions(spark, d)
    return source.read_committed(demo.batches(spark, d), aborted, markers).select("partition", "offset", "producer", "transactional")


@named("""with x as (select event_id, props, case event_id % 4 when 0 then '00' || lpad(printf('%x', event_id), 8, '0') when 1 then '0300' || md5(event_id::varchar)
             when 2 then '' else 'ff' end as head from events)
    select event_id, case event_id % 4 when 0 then 'id' when 1 then 'uuid' when 2 then 'guid' end as kind,
      case event_id % 4 when 0 then event_id::varchar when 1 then md5(event_id::varchar) when 2 then md5('g' || event_id::varchar) end as id,
      case event_id % 4 when 3 then 'FF' || hex(props) when 2 then hex('xy' || props) else hex(props) end as body from x""")  # fmt: skip
def wire_headers(spark, d):
    e = _t(spark, d, "events")
    text = F.col("event_id").cast("string")
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    body = F.col("props").cast("binary")
    kind = F.col("event_id") % 4
    payload = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex("event_id"), 8, "0")), body))
        .when(kind == 1, F.concat(F.unhex(F.lit("0300")), digest(text), body)).when(kind == 2, body).otherwise(F.concat(F.unhex(F.lit("FF")), body))
    )
    header = F.struct(F.lit("__value_schema_id").alias("key"), F.concat(F.unhex(F.lit("01")), digest(F.concat(F.lit("g"), text)), F.lit(b"xy")).alias("value"))
    headers = F.when(kind == 2, F.array(header)).otherwise(F.array().cast(source.HEADERS))
    found = e.select("event_id", wire.wire_header(payload, headers).alias("w"))
    return found.select("event_id", "w.kind", "w.id", F.hex("w.body").alias("body"))


@named(f"""with {LOG} select p, o, case when v is null then 'null' when o % 3 = 0 then 'raw' else 'columns' end as route from log""")
def part_routing(spark, d):
    from tideframe.sources.decode import routed

    r = demo.records(spark, d).withColumn("schema_id", F.when(F.col("o") % 3 != 0, F.concat(F.lit("s"), F.col("o") % 2)))
    return routed(r, "v", ["s0", "s1"]).select("p", "o", "route")


@named(f"with {LOG} select p, min(o) as \"offset\" from log where ts >= (select ts from log where p = 0 and o = 100) group by p")
def offset_at_timestamp(spark, d):
    log = source.events_log(spark, d)
    ts = log.where("_kafka_partition = 0 and _kafka_offset = 100").select("_kafka_timestamp").first()[0]
    return source.offset_at(log, F.lit(ts)).select(F.col("_kafka_partition").alias("p"), "offset")


@named(f"with {LOG} select o, ts, k, v from log where p = 1 and o >= 40 and o < 240 order by o limit 20")
def records_page(spark, d):
    page = source.browse(source.events_log(spark, d), 1, 40, 20)
    return page.select(F.col("_kafka_offset").alias("o"), F.col("_kafka_timestamp").alias("ts"), F.col("_kafka_key").cast("string").alias("k"), F.col("_kafka_value").cast("string").alias("v"))


@named(f"""with {LOG} select o, o::varchar as n, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as at, k as bytes, case when o % 2 = 0 then base64(from_hex('FF' || hex(k))) else k end as mixed, p
    from log""")  # fmt: skip
def rendered_values(spark, d):
    log = source.events_log(spark, d)
    mixed = F.when(F.col("_kafka_offset") % 2 == 0, F.concat(F.unhex(F.lit("FF")), F.col("_kafka_key"))).otherwise(F.col("_kafka_key"))
    r = render.rendered
    return log.select(
        F.col("_kafka_offset").alias("o"), r(F.col("_kafka_offset"), T.LongType()).alias("n"), r(F.col("_kafka_timestamp"), T.TimestampNTZType()).alias("at"),
        r(F.col("_kafka_key"), T.BinaryType()).alias("bytes"), r(mixed, T.BinaryType()).alias("mixed"), F.col("_kafka_partition").alias("p"),
    )


@named(f"""with {LOG}, x as (select *, case when t = 'purchase' then 'purchase' end as h from log)
    select p, o, case when h is null then '[]' else '[{{"key":"type","value":"' || lower(hex(h)) || '"}}]' end as headers, epoch_us(ts) // 1000 as ms from x""")
def headers_transformed(spark, d):
    log = source.events_log(spark, d)
    heads = F.transform("_kafka_headers", lambda h: F.struct(h["key"].alias("key"), F.lower(F.hex(h["value"])).alias("value")))
    return log.select(F.col("_kafka_partition").alias("p"), F.col("_kafka_offset").alias("o"), F.to_json(heads).alias("headers"), source.millis(F.col("_kafka_timestamp")).alias("ms"))


# -- buckets, groups, files -------------------------------------------------------------------------

_SHIFTED = f"{LOG}, x as (select p, o, ms - case when o % 2 = 0 then 1800000000001 else 0 end as ms from log)"
_DAY0 = "date '1970-01-01' + cast(floor(ms / 86400000.0) as int)"
_MONTH = f"((extract(year from {_DAY0}) - 1970) * 12 + extract(month from {_DAY0}) - 1)::int"


def _shifted(spark, d):
    return demo.records(spark, d).select("p", "o", (F.col("ms") - F.when(F.col("o") % 2 == 0, F.lit(1_800_000_000_001)).otherwise(0)).alias("ms"))


def _bucketed(spark, d, grain):
    b = buckets.bucket(F.col("ms"), grain)
    end = buckets.bucket_end_ms(F.col("bucket"), grain)
    return _shifted(spark, d).withColumn("bucket", b).select("p", "o", "bucket", end.alias("end_ms"), buckets.bucket_ended(F.col("bucket"), grain, 800_000_000_000).alias("ended"))


@named(f"with {_SHIFTED}, y as (select p, o, cast(floor(ms / 3600000.0) as int) as bucket from x) select *, (bucket + 1) * 3600000::bigint as end_ms, (bucket + 1) * 3600000::bigint <= 800000000000 as ended from y")
def bucket_hour(spark, d):
    return _bucketed(spark, d, "hour")


@named(f"with {_SHIFTED}, y as (select p, o, cast(floor(ms / 86400000.0) as int) as bucket from x) select *, (bucket + 1) * 86400000::bigint as end_ms, (bucket + 1) * 86400000::bigint <= 800000000000 as ended from y")
def bucket_day(spark, d):
    return _bucketed(spark, d, "day")


@named(f"""with {_SHIFTED}, y as (select p, o, {_MONTH} as bucket from x), z as (select *, epoch_ms((date '1970-01-01' + to_months(bucket + 1))::timestamp) as end_ms from y)
    select *, end_ms <= 800000000000 as ended from z""")
def bucket_month(spark, d):
    return _bucketed(spark, d, "month")


_GROUPS = f"""{LOG}, r as (select p, o, ms, sz, cast(floor(ms / 3600000.0) as int) as b from log),
    g(p, o, no, first, size, top, closed) as (
      select p, o, 0, ms, sz, b, sz >= 400 or false from r where o = 0
      union all
      select r.p, r.o, g.no + (g.closed or r.b > g.top)::int, case when g.closed or r.b > g.top then r.ms else g.first end,
        case when g.closed or r.b > g.top then r.sz else g.size + r.sz end, case when g.closed or r.b > g.top then r.b else greatest(g.top, r.b) end,
        case when g.closed or r.b > g.top then r.sz >= 400 else g.size + r.sz >= 400 or r.ms - g.first >= 7200000 end
      from g join r on r.p = g.p and r.o = g.o + 1)"""


def _grouped(spark, d):
    r = demo.records(spark, d).select(F.col("p").alias("partition"), F.col("o").alias("offset"), F.col("ms").alias("ts_ms"), F.col("sz").alias("size"), buckets.bucket(F.col("ms"), "hour").alias("bucket"))
    return grouping.file_groups(r, 400, 7_200_000)


@named(f'with recursive {_GROUPS} select p as partition, o as "offset", no::bigint as "group" from g')
def file_groups(spark, d):
    return _grouped(spark, d).select("partition", "offset", "group")


@named(f"""with recursive {_GROUPS}, x as (select g.p, no, min(g.o) as start, max(g.o) as last_o, count(*) as records, sum(sz)::bigint as bytes from g join r using (p, o) group by g.p, no)
    select p as partition, no::bigint as "group", start, coalesce(lead(start) over w, last_o + 1) as "end", records, bytes, lead(start) over w is null as last from x window w as (partition by p order by no)""")
def group_ranges(spark, d):
    return grouping.group_ranges(_grouped(spark, d)).select("partition", "group", "start", "end", "records", "bytes", "last")


@named(f'with {FILES} select partition, start, "end", bucket, records, bytes, first_ts_ms from files')
def range_bucket_files(spark, d):
    r = demo.records(spark, d)
    top = r.groupBy("p").agg((F.max("o") + 1).alias("top"))
    start = F.expr(f"(o div {RANGE}) * {RANGE}")
    r = r.join(F.broadcast(top), "p").select(F.col("p").alias("partition"), start.alias("start"), F.least(start + RANGE, F.col("top")).alias("end"), buckets.bucket(F.col("ms"), "day").alias("bucket"), F.col("ms").alias("ts_ms"), F.col("sz").alias("size"))
    return grouping.bucket_files(r)


@named("""select event_type, 'event_id' as field, count(*) as "rows", count(*) - count(event_id) as nulls, null::bigint as nans, min(event_id)::varchar as lower, max(event_id)::varchar as upper from events group by event_type
    union all select event_type, 'value', count(*), count(*) - count(v), count(*) filter (where isnan(v)), (min(v) filter (where not isnan(v)))::varchar, (max(v) filter (where not isnan(v)))::varchar
      from (select event_type, case when event_id % 50 = 0 then 'nan'::double when event_id % 50 = 1 then null else floor(value) end as v from events) group by event_type
    union all select event_type, 'props', count(*), count(*) - count(props), null, min(props)[:16], case when length(max(props)) <= 16 then max(props) end from events group by event_type""")  # fmt: skip
def column_stats(spark, d):
    e = _t(spark, d, "events")
    v = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.floor("value").cast("double"))
    return stats.column_stats(e.withColumn("value", v), ["event_type"], ["event_id", "value", "props"])


@named("""with x as (select p_name as t from part) select t, t[:5] as lower, case when length(t) <= 5 then t else t[:4] || chr((unicode(t[5]) + 1)::int) end as upper from x""")
def truncated_bounds(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("t"))
    return p.select("t", render.lower_bound(F.col("t"), 5).alias("lower"), render.upper_bound(F.col("t"), 5).alias("upper"))


@named()
def ndv_theta(spark, d):
    e = _t(spark, d, "events")
    return stats.distinct_counts(stats.sketches(e, F.col("ts").cast("date"), ["user_id", "event_type", "event_id"]))


@named(f"""with {FILES}, r as (select distinct partition, start, "end" from files), x as (select *, lag("end") over (partition by partition order by start, "end") as before from r where start <> 500)
    select partition, start, "end", before from x where before is not null and before <> start""")
def not_adjacent(spark, d):
    return planning.not_adjacent(demo.files(spark, d).where("start <> 500")).select("partition", "start", "end", "before")



# -- snapshots and views ----------------------------------------------------------------------------


@named(f"""with {SNAPSHOTS} select f.partition, f.start, f."end", f.bucket from files f join offsets o on o.id = 2 and o.partition = f.partition and o.start <= f.start and f."end" <= o."end"
    where coalesce(replaced, 4611686018427387904) > 2 and added <= 2""")
def as_of_snapshot(spark, d):
    return planning.files_of(demo.files(spark, d), demo.offsets(spark, d), 2).select("partition", "start", "end", "bucket")


@named(f"""with {SNAPSHOTS}, b as (select * from files where added <= 2), a as (select * from files where added <= 3 and start <> 0)
    select 'overwrite' as operation, (select count(*) from a where not exists (select 1 from b where (b.partition, b.start, b.bucket) = (a.partition, a.start, a.bucket))) as added_files,
      (select coalesce(sum(records), 0)::bigint from a where not exists (select 1 from b where (b.partition, b.start, b.bucket) = (a.partition, a.start, a.bucket))) as added_records,
      (select count(*) from b where start = 0) as deleted_files, (select sum(records)::bigint from b where start = 0) as deleted_records,
      (select count(*) from a) as total_files, (select coalesce(sum(records), 0)::bigint from a) as total_records
    where exists (select 1 from files where added = 3)
    union all select 'delete', 0, 0, (select count(*) from b where start = 0), (select sum(records)::bigint from b where start = 0), (select count(*) from a), (select coalesce(sum(records), 0)::bigint from a)
    where not exists (select 1 from files where added = 3)""")  # fmt: skip
def commit_summary(spark, d):
    f = demo.files(spark, d)
    return planning.commit_summary(f.where("added <= 2"), f.where("added <= 3 and start <> 0"))


# -- compaction, tiering, upkeep --------------------------------------------------------------------

_RUNS = f"""{FILES}, f as (select *, row_number() over (partition by partition, bucket order by start) as n from files),
    runs(partition, bucket, n, start, "end", size, run) as (
      select partition, bucket, n, start, "end", bytes, 0 from f where n = 1
      union all select f.partition, f.bucket, f.n, f.start, f."end",
        case when r.size + f.bytes > 9000 then f.bytes else r.size + f.bytes end, r.run + (r.size + f.bytes > 9000)::int
      from runs r join f on f.partition = r.partition and f.bucket = r.bucket and f.n = r.n + 1)"""


@named(f"""with recursive {_RUNS} select f.partition, f.bucket, r.run::bigint as run, min(f.start) as start, max(f."end") as "end", count(*) as files, sum(records)::bigint as records, sum(bytes)::bigint as bytes,
      sha256(string_agg(f.start::varchar || ':' || f."end"::varchar || chr(10), '' order by f.start))[:16] as hash
    from runs r join f using (partition, bucket, n) group by f.partition, f.bucket, r.run having count(*) >= 2""")
def assembly_runs(spark, d):
    return planning.assembly_runs(demo.files(spark, d), 9000, F.lit(True)).select("partition", "bucket", "run", "start", "end", "files", "records", "bytes", "hash")


@named(f"with {LOG} select p, count(*) as n, count(distinct o) as offsets, sum(sz)::bigint as bytes from log group by p")
def assembly_rewrite(spark, d):
    """A table's records read from compacted files: what was put together is what there was."""
    import uuid

    from tideframe.engine import Engine

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    engine = Engine(spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    engine.add_table("events", 4, granularity="month", file_bytes=1 << 14, file_window_ms=400 * buckets.DAY_MS)
    engine.ingest("events", source.events_log(spark, d), now_ms=1)
    engine.compact("events", 1 << 42)
    rows = engine.load("events").withColumn("sz", source.record_bytes())
    return rows.groupBy(F.col("_kafka_partition").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_kafka_offset").alias("offsets"), F.sum("sz").alias("bytes"))


@named("""select 'event_id' as field, count(*) as "rows", count(*) - count(event_id) as nulls, null::bigint as nans, min(event_id)::varchar as lower, max(event_id)::varchar as upper from events
    union all select 'user_id', count(*), count(*) - count(user_id), null, min(user_id)::varchar, max(user_id)::varchar from events
    union all select 'value', count(*), count(*) - count(v), 0, min(v)::varchar, max(v)::varchar from (select floor(value) as v from events)
    union all select 'ts', count(*), count(*) - count(ts), null, strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S') from (select date_trunc('second', ts)::timestamp as ts from events)
    union all select 'event_type', count(*), count(*) - count(event_type), null, min(event_type), max(event_type) from events""")  # fmt: skip
def merged_statistics(spark, d):
    """The parts' statistics put together are the table's: bounds are compared as values of their types."""
    e = _t(spark, d, "events").withColumns({"part": F.col("user_id") % 7, "value": F.floor("value").cast("double"), "ts": F.date_trunc("SECOND", "ts").cast("timestamp_ntz")})
    parts = stats.column_stats(e, ["part"], ["event_id", "user_id", "value", "ts", "event_type"])
    return stats.merged_stats(parts, ["field"], e.schema)


@named(f"with {FILES} select bucket, added, count(*) as files, min(start) as low, max(\"end\") as high from files group by all")
def manifests(spark, d):
    return planning.manifests(demo.files(spark, d)).drop("spec")


@named(f"""with {SNAPSHOTS}, now as (select max(committed_ms) as t from snapshots) select id from snapshots, now
    where id < (select max(id) from snapshots) and id <= (select max(id) from snapshots, now where committed_ms < t - 86400000)""")
def expired_snapshots(spark, d):
    s = demo.snapshots(spark, d)
    now = s.agg(F.max("committed_ms")).first()[0]
    none = spark.createDataFrame([], "partition int, earliest long")
    return planning.expired_snapshots(s, demo.offsets(spark, d), now, 86_400_000, none)


@named(f'with {FILES} select partition, coalesce(min(start) filter (start >= 300), max("end")) as start from files group by partition')
def retention_trim(spark, d):
    earliest = spark.createDataFrame([(p, 300) for p in range(4)], "partition int, earliest long")
    return planning.retained_starts(demo.files(spark, d), earliest)


@named(f"""with {FILES} select partition::varchar || '/' || start::varchar || '/' || bucket::varchar as path from files where start >= 500 and first_ts_ms < (select max(first_ts_ms) from files) - 3600000""")
def collectable_objects(spark, d):
    f = demo.files(spark, d)
    path = F.concat_ws("/", F.col("partition").cast("string"), F.col("start").cast("string"), F.col("bucket").cast("string"))
    now = f.agg(F.max("first_ts_ms")).first()[0]
    return planning.collectable(f.select(path.alias("path"), F.col("first_ts_ms").alias("modified_ms")), f.where("start < 500").select(path.alias("path")), now, 3_600_000).select("path")


@named()
def tier_flushes(spark, d):
    f = demo.files(spark, d)
    cutoff = f.agg(F.expr("percentile(first_ts_ms, 0.7)")).first()[0]
    starts = spark.createDataFrame([(p, 0) for p in range(4)], "partition int, start long")
    flushes = planning.tier_flushes(planning.tier_pieces(f, starts, int(cutoff)), int(cutoff), 12_000)
    return flushes.select("partition", "flush", "start", "end", "bytes", F.size("reads").alias("reads"))


@named(f"with {FILES} select partition, min(first_ts_ms) as oldest_untiered_ms from files where start >= 500 group by partition")
def tier_lag(spark, d):
    ends = spark.createDataFrame([(p, 500) for p in range(4)], "partition int, tier_end long")
    return planning.tier_lag(demo.files(spark, d), ends)


@named(f"""with {FILES}, r as (select distinct partition, start, "end" from files where start <> 750) select partition, start, "end" from r where start >= 250 and start < 750""")
def tier_append(spark, d):
    r = demo.files(spark, d).select("partition", "start", "end").distinct().where("start <> 750")
    return planning.contiguous(r, spark.createDataFrame([(p, 250) for p in range(4)], "partition int, tier_end long"))


@named("""select l_orderkey, l_linenumber, l_returnflag as flag, (l_quantity - l_quantity % 10)::int as tens, ((extract(year from l_shipdate) - 1970) * 12 + extract(month from l_shipdate) - 1)::int as month,
    date_diff('day', date '1970-01-01', l_shipdate::date)::int as day, l_shipmode2 as head from (select *, l_linestatus || l_returnflag || 'xyz' as l_shipmode2_full, (l_linestatus || l_returnflag || 'xyz')[:2] as l_shipmode2 from lineitem)""")  # fmt: skip
def tier_sorted_write(spark, d):
    """Partition values of the transforms, over rows dealt out and sorted as a history write does it."""
    li = _t(spark, d, "lineitem").withColumns({"q": F.col("l_quantity").cast("int"), "s": F.concat("l_linestatus", "l_returnflag", F.lit("xyz"))})
    out = tiering.laid_out(li, ["l_returnflag", "truncate(10, q)", "month(l_shipdate)", "day(l_shipdate)", "truncate(2, s)"], ["l_orderkey desc", "l_linenumber"], splits=2)
    return out.select(
        "l_orderkey", "l_linenumber", F.col("_part_l_returnflag").alias("flag"), F.col("_part_q_truncate").alias("tens"), F.col("_part_l_shipdate_month").alias("month"),
        F.col("_part_l_shipdate_day").alias("day"), F.col("_part_s_truncate").alias("head"),
    )


@named("""with n as (select n_name as name from nation), k as (select r_name as node from region), x as (select name, node, sha256(node || ':' || name)[:16] as h from n, k)
    select name, arg_max(node, h) as owner from x group by name""")
def rendezvous_owner(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"))
    nodes = [r.r_name for r in _t(spark, d, "region").orderBy("r_name").collect()]  # the cluster's nodes, not data
    return owners(n, nodes)


# -- control plane ----------------------------------------------------------------------------------


@named(f'with {FILES} select partition, start, "end", bucket from files where partition = 1 and start >= 250 and "end" <= 1000 and replaced is null')
def live_files(spark, d):
    return control.live_files(demo.files(spark, d), 1, 250, 1000).select("partition", "start", "end", "bucket")


@named(f"""with {SNAPSHOTS}, h as (select s.id, f.* from snapshots s join offsets o on o.id = s.id join files f on f.partition = o.partition and o.start <= f.start and f."end" <= o."end"
      where coalesce(replaced, 4611686018427387904) > s.id and added <= s.id), p as (select id, lag(id) over (order by id) as previous from snapshots)
    select 1 as topic_id, h.id, previous, count(*) as files, sum(records)::bigint as records,
      count(*) filter (where not exists (select 1 from h b where b.id = p.previous and b.partition = h.partition and b.start = h.start and b.bucket = h.bucket)) as new_files
    from h join p on p.id = h.id group by h.id, previous""")
def snapshot_totals(spark, d):
    return control.snapshot_totals(demo.snapshots(spark, d), demo.offsets(spark, d), demo.files(spark, d))


@named(f"""with {RANGES} select f.partition, f.start, f.bucket from files f where not exists (select 1 from ranges r where r.partition = f.partition and r.start <= f.start and f."end" <= r."end")""")
def trimmed_files(spark, d):
    return control.trimmed_files(demo.files(spark, d), demo.ranges(spark, d)).select("partition", "start", "bucket")


@named(f"with {SNAPSHOTS} select partition, start, bucket from files where replaced <= (select min(id) from snapshots where id >= 3)")
def replaced_files(spark, d):
    return control.replaced_files(demo.files(spark, d), demo.snapshots(spark, d).where("id >= 3")).select("partition", "start", "bucket")


@named(f"""with {SNAPSHOTS}, {TOPICS}, l as (select topic_id, max(id) as snapshot, arg_max(committed_ms, id) as committed_ms from snapshots group by 1),
    s as (select topic_id, sum(records)::bigint as records, sum(bytes)::bigint as bytes, count(*) as files from files where replaced is null group by 1)
    select name, state, snapshot, committed_ms, coalesce(records, 0) as records, coalesce(bytes, 0) as bytes, coalesce(files, 0) as files from topics left join l using (topic_id) left join s using (topic_id)""")
def table_summaries(spark, d):
    return control.table_summaries(demo.topics(spark, d), demo.snapshots(spark, d), demo.files(spark, d))


@named(f"""with {FILES}, {TOPICS} select (select count(*) from topics) as topics, (select count(*) from topics where state = 'indexing') as listed, count(*) as files, sum(records)::bigint as records, sum(bytes)::bigint as bytes from files""")
def global_totals(spark, d):
    return control.totals(demo.topics(spark, d), demo.files(spark, d))


@named(f"with {TOPICS} select name from topics where starts_with(name, 'N') and name > 'NATION_1' order by name limit 5")
def table_listing(spark, d):
    return control.listing(demo.topics(spark, d), "N", "NATION_1", 5).select("name")


@named(f"""with {FILES} select partition, start, "end", bucket from files where (partition, start, "end", bucket) > (1, 500, 750, -1) order by partition, start, "end", bucket limit 15""")
def files_page(spark, d):
    return control.files_page(demo.files(spark, d), (1, 1, 500, 750, -1), None, 15).select("partition", "start", "end", "bucket")


@named(f"""with {SNAPSHOTS}, s as (select id, sum("end" - start)::bigint as span from offsets group by id) select id, committed_ms, span from snapshots join s using (id) where id < 3 order by id desc limit 2""")
def snapshots_page(spark, d):
    return control.snapshots_page(demo.snapshots(spark, d), demo.offsets(spark, d), 3, 2).select("id", "committed_ms", "span")


@named("""select n_regionkey as schema_id, 'avro' as kind, array_to_string(list_sort(list_distinct(list(n_name))), ',') as topics from nation where n_regionkey < 3 group by 1
    union all select r_regionkey, 'avro', '' from region where r_regionkey >= 3""")  # fmt: skip
def registry_page(spark, d):
    s = _t(spark, d, "region").select(F.col("r_regionkey").alias("schema_id"), F.lit("avro").alias("kind"))
    uses = _t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_regionkey").alias("schema_id"), F.col("n_name").alias("topic"))
    return control.registry_page(s, uses).withColumn("topics", F.array_join("topics", ","))


@named("select distinct n_name as topic from nation where n_regionkey = 2")
def schema_tables(spark, d):
    return control.schema_tables(_t(spark, d, "nation").select(F.col("n_regionkey").alias("schema_id"), F.col("n_name").alias("topic")), 2)


@named(f"with {SNAPSHOTS}, {TOPICS} select name from topics where state = 'indexing' and topic_id in (select topic_id from snapshots)")
def listed_topics(spark, d):
    return control.listed_topics(demo.topics(spark, d), demo.snapshots(spark, d))


_LEASES = "leases as (select c_name as resource, case when c_custkey % 3 = 0 then null else 'n' || (c_nationkey % 4)::varchar end as owner, (c_custkey % 7)::bigint as epoch, c_custkey * 10 as until_ms from customer)"


def _leases(spark, d):
    c = _t(spark, d, "customer")
    owner = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("n"), (F.col("c_nationkey") % 4).cast("string")))
    return c.select(F.col("c_name").alias("resource"), owner.alias("owner"), (F.col("c_custkey") % 7).alias("epoch"), (F.col("c_custkey") * 10).alias("until_ms"))


@named(f"with {_LEASES} select resource, coalesce(owner, '') as owner, epoch from leases where (resource, coalesce(owner, '')) > ('Customer#000000050', 'n1') order by 1, 2 limit 12")
def leases_page(spark, d):
    return control.leases_page(_leases(spark, d), ("Customer#000000050", "n1"), 12).select("resource", "owner", "epoch")


@named(f"""with {_LEASES} select resource, case when t then 'n1' else owner end as owner, case when t and owner is distinct from 'n1' then epoch + 1 else epoch end as epoch, case when t then 1500 else until_ms end as until_ms
    from (select *, owner is not distinct from 'n1' or owner is null or until_ms <= 500 as t from leases)""")
def lease_claim(spark, d):
    return control.claim(_leases(spark, d), "n1", None, 500, 1000)


@named(f"""with {FILES}, r as (select distinct partition, start, case when start % 500 = 0 then "end" + 100 else "end" end as "end" from files),
    x as (select *, max("end") over (partition by partition order by start, "end" rows between unbounded preceding and 1 preceding) as reach from r) select partition, start, "end" from x where start < reach""")
def overlap_check(spark, d):
    f = demo.files(spark, d).select("topic_id", "partition", "start", F.when(F.col("start") % 500 == 0, F.col("end") + 100).otherwise(F.col("end")).alias("end")).distinct()
    return control.overlapping(f).select("partition", "start", "end")


@named("select 'a/b' as location, 't2' as \"table\"")
def longest_prefix_owner(spark, d):
    rows = [("a", "t1"), ("a/b", "t2"), ("a/bc", "t3"), ("b", None)]
    return control.owner_of(spark.createDataFrame(rows, "location string, table string"), "a/b/c/d")


@named("""select location, "table" from (values ('a', 't1'), ('a/b/x', 't3'), ('a/b/y', null)) v(location, "table")""")
def location_conflicts(spark, d):
    rows = [("a", "t1"), ("a/b", "t2"), ("a/bc", "t3"), ("a/b/x", "t3"), ("a/b/y", None)]
    return control.conflicting(spark.createDataFrame(rows, "location string, table string"), "a/b", "t2")


@named(f"""with {FILES}, r as (select distinct partition, start, "end" from files) select partition, start, "end" from r where "end" <= 500 and partition <> 3 and exists (select 1 from r where "end" = 500)""")
def settled_ranges(spark, d):
    r = demo.files(spark, d).select("partition", "start", "end").distinct()
    ends = spark.createDataFrame([(p, 500 if p < 3 else 510) for p in range(4)], "partition int, end long")
    return control.settled(r, ends)


@named(f"""with {FILES} select partition, max("end") as tier_end from (select partition, "end" from files where start < 500 union all select partition, "end" from files where start < 1000 and partition = 2) group by partition""")
def tier_ends(spark, d):
    f = demo.files(spark, d)
    return control.tier_ends(f.where("start < 500"), f.where("start < 1000 and partition = 2"))


@named(f"""with {FILES} select partition, "end" from files where partition = 1 and start < 500 and "end" > 100 and "end" < 600 order by "end" limit 1""")
def tier_end_inside(spark, d):
    f = demo.files(spark, d).where("start < 500")
    return control.crossing_end(f, f.where("partition = 9"), 1, 100, 600)


@named(f"""with {RANGES} select f.topic_id, min(first_ts_ms) as earliest_ms from files f join ranges r on r.partition = f.partition and r.start <= f.start and f."end" <= r."end" group by 1""")
def earliest_live(spark, d):
    return control.earliest_live(demo.files(spark, d), demo.ranges(spark, d))


@named(f"with {TOPICS} select name from topics where state = 'removing'")
def removable_tables(spark, d):
    return control.removable(demo.topics(spark, d), demo.snapshots(spark, d), 1 << 60)


# -- pushdown ---------------------------------------------------------------------------------------


@named("""select event_id, user_id, value from events where ((event_id >= 100 and event_id < 4000) or event_id in (7, 9)) and event_type in ('click', 'view') order by value desc, event_id limit 25""")
def scan_pushdown(spark, d):
    D = pruning.Domain
    request = pruning.Request(("EVENT_ID", "user_id", "value"), {"event_id": D(((100, 4000, True, False),), (7, 9)), "event_type": D(values=("click", "view"))}, (("value", True, False), ("event_id", False, False)), 25)
    return pruning.scan(_t(spark, d, "events"), request)


@named(f"""with {FILES} select partition, start, bucket from files where "end" - 1 >= 300 and start <= 900""")
def pruned_files(spark, d):
    f = demo.files(spark, d).withColumns({"lower_o": F.col("start"), "upper_o": F.col("end") - 1})
    return pruning.pruned(f, {"o": pruning.Domain(((300, 900, True, True),)), "unknown": pruning.Domain()}).select("partition", "start", "bucket")


@named(f"with {LOG} select p, o, ts from log order by ts desc, p, o limit 10")
def top_n_latest(spark, d):
    return pruning.scan(demo.records(spark, d), pruning.Request(("p", "o", "ts"), {}, (("ts", True, False), ("p", False, True), ("o", False, True)), 10))


@named(f"with {LOG} select p, o from log where ms >= (select max(ms) from log) - 3600000")
def pruned_hour(spark, d):
    r = demo.records(spark, d).withColumn("b", buckets.bucket(F.col("ms"), "hour"))
    since = r.agg(F.max("ms")).first()[0] - buckets.HOUR_MS
    return r.where((F.col("b") >= since // buckets.HOUR_MS) & (F.col("ms") >= since)).select("p", "o")


@named(f"with {LOG} select p, o, v from log where o between 120 and 140")
def offset_filter(spark, d):
    return pruning.scan(demo.records(spark, d), pruning.Request(("p", "o", "v"), {"o": pruning.Domain(((120, 140, True, True),))}))


# -- query shapes -----------------------------------------------------------------------------------


def _q1(spark, d):
    li = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-12-01 00:00:00' - interval 90 days"))
    price, discount, tax = _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(_cents("l_quantity")).cast("double").alias("sum_qty"), F.sum(price).cast("double").alias("sum_base_price"),
        F.sum(price * (1 - discount)).cast("double").alias("sum_disc_price"), F.sum(price * (1 - discount) * (1 + tax)).cast("double").alias("sum_charge"),
        F.round(F.sum(_cents("l_quantity")).cast("double") / F.count(F.lit(1)), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order"),
    ).orderBy("l_returnflag", "l_linestatus")


@named("""select l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::double as sum_qty, sum(l_extendedprice::decimal(18,2))::double as sum_base_price,
    sum(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))::double as sum_disc_price,
    sum((l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2))) * (1 + l_tax::decimal(18,2)))::double as sum_charge,
    round(sum(l_quantity::decimal(18,2))::double / count(*), 6) as avg_qty, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-12-01' - interval 90 day group by all order by all""")  # fmt: skip
def tpch_q1(spark, d):
    return _q1(spark, d)


def _q6(spark, d, year):
    li = _t(spark, d, "lineitem")
    some = (F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))
    some = some & _cents("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)
    return li.where(some).agg(F.sum(_cents("l_extendedprice") * _cents("l_discount")).cast("double").alias("revenue"))


def _q6_sql(year: int) -> str:
    return f"""select sum(l_extendedprice::decimal(18,2) * l_discount::decimal(18,2))::double as revenue from lineitem where l_shipdate >= timestamp '{year}-01-01'
        and l_shipdate < timestamp '{year + 1}-01-01' and l_discount::decimal(18,2) between 0.05 and 0.07 and l_quantity < 24"""


@named(_q6_sql(1994))
def tpch_q6(spark, d):
    return _q6(spark, d, 1994)


@named(_q6_sql(1996))
def tpch_q6_1996(spark, d):
    return _q6(spark, d, 1996)


@named("select user_id, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from events group by user_id")
def positions_per_user(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@named("select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _t(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "ts", "event_type")


@named(f"with {LOG} select count(*) as n, count(distinct (p, o)) as distinct_n, (select count(*) from (select distinct p, o from log)) as rows_n from log")
def distinct_partition_offset(spark, d):
    r = demo.records(spark, d)
    each = r.groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_n"), F.count(F.struct("p", "o")).alias("rows_n"))


@named(f"with {LOG} select json_extract_string(v, '$.k') as kind, count(*) as n from log group by 1")
def json_kind_counts(spark, d):
    return demo.records(spark, d).groupBy(F.get_json_object("v", "$.k").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@named(f"with {LOG} select p, o, case when o % 3 = 1 then o end as number, o % 3 <> 1 as raw from log")
def typed_columns(spark, d):
    """Records of several schema versions: the promoted column where decoded, raw bytes elsewhere."""
    r = demo.records(spark, d)
    f = lambda name, kind, i: T.StructField(name, kind, True, {"id": i})
    now = T.StructType([f("p", T.IntegerType(), 1), f("o", T.LongType(), 2), f("number", T.LongType(), 10), f("raw", T.StringType(), 6)])

    def part(df, kind):
        c = F.col("o").cast(kind) if kind else F.lit(None).cast("int")
        out = df.select("p", "o", c.alias("n"), (F.lit(None).cast("string") if kind else F.col("v")).alias("raw"))
        old = {"p": 1, "o": 2, "n": 10, "raw": 6}
        return out.select(*[F.col(x).alias(x, metadata={"id": i}) for x, i in old.items()])

    both = schema.read_versions([part(r.where("o % 3 = 1"), "int"), part(r.where("o % 3 <> 1"), None)], now)
    return both.select("p", "o", "number", F.col("raw").isNotNull().alias("raw"))


@named("""select event_id, coalesce(case when event_id % 3 = 0 then event_id end, case when event_id % 3 = 1 then event_id end, event_id)::bigint as id, case when event_id % 3 > 0 then value::float::double end as amount,
    case when event_id % 3 = 0 then user_id::varchar when event_id % 3 = 1 then event_type else 'x' end as state, case when event_id % 3 = 0 then user_id::int end as legacy_s3, case when event_id % 3 = 2 then props end as legacy from events""")  # fmt: skip
def evolved_schema_read(spark, d):
    """Three versions of a schema: promotion (int to long, float to double), rename by alias, a replaced column."""
    e = _t(spark, d, "events")
    v1 = T.StructType([schema.field("id", T.IntegerType()), schema.field("status", T.StringType()), schema.field("legacy", T.IntegerType())])
    v2 = T.StructType([schema.field("id", T.LongType()), schema.field("status", T.StringType()), schema.field("amount", T.FloatType())])
    v3 = T.StructType([schema.field("id", T.LongType()), schema.field("state", T.StringType(), aliases=("status",)), schema.field("amount", T.DoubleType()), schema.field("legacy", T.StringType())])
    s1 = schema.merge(T.StructType(), v1, 1)
    s2 = schema.merge(s1, v2, 2)
    s3 = schema.merge(s2, v3, 3)
    k = F.col("event_id") % 3
    fits = F.col("event_id").between(-(1 << 31), (1 << 31) - 1)

    def version(written, where, **columns):
        kept = [c.alias(n, metadata={"id": written[n].metadata["id"]}) for n, c in columns.items()]
        return e.where(where).select(F.col("event_id").alias("event_id", metadata={"id": 2}), *kept)

    now = T.StructType([T.StructField("event_id", T.LongType(), True, {"id": 2}), *s3.fields])
    first = {"status": F.col("user_id").cast("string"), "legacy": F.col("user_id").cast("int")}
    return schema.read_versions(
        [
            version(s1, (k == 0) & fits, id=F.col("event_id").cast("int"), **first),
            version(s2, (k == 0) & ~fits, id=F.col("event_id"), **first),  # such an id is only written once the column is long
            version(s2, k == 1, id=F.col("event_id"), status=F.col("event_type"), amount=F.col("value").cast("float")),
            version(  # all the rest, null and negative ids too
                s3, ~F.coalesce(k.isin(0, 1), F.lit(False)),
                id=F.col("event_id"), state=F.lit("x"), amount=F.when(k > 0, F.col("value").cast("float").cast("double")), legacy=F.when(k == 2, F.col("props")),
            ),
        ],
        now,
    )


@named(f"with {LOG} select count(*) as n from log a join log b on a.o = b.o and b.p = 0 and a.p = 1")
def offset_self_join(spark, d):
    r = demo.records(spark, d)
    return r.where("p = 1").join(r.where("p = 0").select("o"), "o").agg(F.count(F.lit(1)).alias("n"))


@named("""with big as (select o_custkey, sum(o_totalprice::decimal(18,2)) as total from orders group by 1) select c_mktsegment, count(*) as n, sum(total)::double as total from big join customer on c_custkey = o_custkey group by 1""")
def cte_join(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("tf_orders")
    _t(spark, d, "customer").createOrReplaceTempView("tf_customer")
    return spark.sql("""with big as (select o_custkey as c_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from tf_orders group by 1)
        select c_mktsegment, count(*) as n, cast(sum(total) as double) as total from big join tf_customer using (c_custkey) group by 1""")


@named("""select i, printf('event-%d', i) as key, ['click', 'view', 'purchase'][i % 3 + 1] as kind, round(sin(i / 10.0), 6) as lat, round(cos(i / 10.0), 6) as lon,
    '{"id":' || i::varchar || ',"kind":"' || ['click', 'view', 'purchase'][i % 3 + 1] || '"}' as value, make_timestamp(1700000000000000 + i * 180000000) as at from range(0, 1000) t(i)""")  # fmt: skip
def generated_events(spark, d):
    i = F.col("i")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase")]), (i % 3 + 1).cast("int"))
    r = spark.range(1000).withColumnRenamed("id", "i").withColumn("kind", kind)
    return r.select(
        "i", F.format_string("event-%d", i).alias("key"), "kind", F.round(F.sin(i / 10.0), 6).alias("lat"), F.round(F.cos(i / 10.0), 6).alias("lon"),
        F.to_json(F.struct(i.alias("id"), "kind")).alias("value"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 180_000_000).cast("timestamp_ntz").alias("at"),
    )


@named()
def decoded_json(spark, d):
    """events.props decoded by a JSON Schema; what does not fit stays raw."""
    from tideframe.sources.decode import JsonSchema, decoded

    spec = {"type": "object", "properties": {"k": {"type": "integer"}}}
    r = demo.records(spark, d).select("p", "o", F.when(F.col("o") % 5 == 0, F.lit('{"k":"x"}')).otherwise(F.col("v")).cast("binary").alias("v"))
    return decoded(r, "v", lambda: JsonSchema(spec)).select("p", "o", F.col("decoded.k").alias("k"), F.col("raw").isNotNull().alias("raw"))


ORACLES["decoded_json"] = f"with {LOG} select p, o, case when o % 5 <> 0 then json_extract_string(v, '$.k')::bigint end as k, o % 5 = 0 as raw from log"


@named(f"with {LOG} select p, count(*) as n, min(o) as low, max(o) as high from log group by p")
def stream_ingest_counts(spark, d):
    """The log indexed into a table by a structured stream, then counted; equal to the batch."""
    import uuid

    from tideframe.engine import Engine

    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams").rstrip("/") + "/" + uuid.uuid4().hex
    log = source.events_log(spark, d)
    top = log.agg(F.max("_kafka_offset")).first()[0] + 1
    engine = Engine(spark, f"{root}/tables")
    engine.add_table("events", 4, granularity="month", file_bytes=1 << 20, file_window_ms=400 * buckets.DAY_MS)
    for part in range(3):  # files arrive in the order of their offsets, those of a third together
        log.where((F.col("_kafka_offset") >= top * part // 3) & (F.col("_kafka_offset") < top * (part + 1) // 3)).write.mode("append").parquet(f"{root}/in")
        engine.follow("events", f"{root}/in", f"{root}/state", files_per_batch=(1 << 31) - 1).awaitTermination()
    return engine.load("events").groupBy(F.col("_kafka_partition").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_kafka_offset").alias("low"), F.max("_kafka_offset").alias("high"))


from tideframe.plans import tables  # noqa: E402, F401  registers the queries over stored tables
