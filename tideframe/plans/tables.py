"""Named queries over tables that the engine has written: views, history, pruning, types, wire and payload formats.

Each table is written once for a session and input, below the shared folder, and only read after that."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideframe.engine import Engine
from tideframe.functions import buckets, sqltext
from tideframe.operators import encoding, paths, pruning, tiering
from tideframe.plans import demo
from tideframe.plans.catalogue import named
from tideframe.plans.demo import FILES, LOG
from tideframe.sources import batches, decode
from tideframe.sources import log as source

_RANGE_ROWS = 1 << 19
_MADE: dict[tuple[str, str, str], Engine] = {}
_WIDE = {"granularity": "month", "file_bytes": 1 << 20, "file_window_ms": 400 * buckets.DAY_MS}


def _made(spark, d: str, make) -> Engine:
    key = spark.sparkContext.applicationId, d, make.__name__
    if key not in _MADE:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
        engine = Engine(spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}")
        make(engine, spark, d)
        _MADE[key] = engine
    return _MADE[key]


def _cut(log, parts: int, of: int):
    """The offset of each partition up to which parts of its records stand."""
    top = log.groupBy("_kafka_partition").agg((F.max("_kafka_offset") + 1).alias("top")).collect()  # one row a log partition
    return {r["_kafka_partition"]: r.top * parts // of for r in top}


def _below(ends: dict[int, int]):
    found = F.lit(False)
    for p, e in ends.items():
        found = found | ((F.col("_kafka_partition") == p) & (F.col("_kafka_offset") < e))
    return found


def _history(engine: Engine, spark, d: str) -> None:
    """events: the first half of each partition in an attached history, three snapshots of the log."""
    log = source.events_log(spark, d)
    half, most = _cut(log, 1, 2), _cut(log, 3, 4)
    engine.add_table("events", 4, **_WIDE)
    engine.ingest("events", log.where(_below(half)), now_ms=1_000)
    where = f"{engine.warehouse}/history"
    tiering.write_history(log.where(_below(half)), where, ["_kafka_partition"], ["_kafka_offset"])
    engine.attach("events", where, half)
    engine.ingest("events", log.where(_below(most) & ~_below(half)), now_ms=2_000)
    engine.ingest("events", log.where(~_below(most)), now_ms=3_000)


def _typed(engine: Engine, spark, d: str) -> None:
    """lineitem as a log with typed columns, a file for each month and partition."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), *[F.col(c) for c in sorted(li.columns) if c not in ("l_shipdate", "l_orderkey", "l_linenumber")]]
    rows = li.withColumn("_kafka_partition", F.pmod("l_orderkey", F.lit(2)).cast("int"))
    rows = _numbered(rows, f"{engine.warehouse}/numbered", "_kafka_partition", order).withColumns({
        "_kafka_timestamp": F.col("l_shipdate").cast("timestamp_ntz"), "_kafka_key": F.encode(F.col("l_orderkey").cast("string"), "UTF-8"),
        "_kafka_headers": F.array().cast(source.HEADERS), "_kafka_value": F.lit(None).cast("binary"),
    })
    engine.add_table("lineitem", 2, granularity="month", file_bytes=1 << 30, file_window_ms=400 * buckets.DAY_MS)
    engine.ingest("lineitem", rows, now_ms=1_000)
    engine.store.delete("numbered")


def _numbered(rows, path: str, key: str, order: list):
    """rows with _kafka_offset, their place in the order of their key; they are sorted in ranges, kept under path, and counted range by range."""
    ranges = max(1, rows.count() // _RANGE_ROWS)
    rows.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_row", 33))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(key, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = counts.select(key, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return kept.join(F.broadcast(counts), [key, "_range"]).withColumn("_kafka_offset", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")


def _specs(engine: Engine, spark, d: str) -> None:
    """events: the first half under hour buckets, the rest under day buckets."""
    log = source.events_log(spark, d)
    half = _cut(log, 1, 2)
    engine.add_table("events", 4, granularity="hour", file_bytes=1 << 20, file_window_ms=400 * buckets.DAY_MS)
    engine.ingest("events", log.where(_below(half)), now_ms=1_000)
    engine.set_granularity("events", "day")
    engine.ingest("events", log.where(~_below(half)), now_ms=2_000)


def _pov(df):
    return df.select(F.col("_kafka_partition").alias("p"), F.col("_kafka_offset").alias("o"), F.col("_kafka_value").cast("string").alias("v"))


_HALF = f"{LOG}, cut as (select p, (max(o) + 1) // 2 as half, (max(o) + 1) * 3 // 4 as most from log group by p), x as (select * from log join cut using (p))"


@named(f"with {LOG} select p, o, v from log")
def view_merged(spark, d):
    return _pov(_made(spark, d, _history).load("events"))


@named(f"with {_HALF} select p, o, v from x where o >= half")
def view_stream(spark, d):
    return _pov(_made(spark, d, _history).load("events", "stream"))


@named(f"with {_HALF} select p, o, v from x where o < half")
def view_lake(spark, d):
    return _pov(_made(spark, d, _history).load("events", "lake"))


@named(f"with {_HALF} select p, o, v from x where o < most")
def time_travel(spark, d):
    return _pov(_made(spark, d, _history).load("events", as_of_timestamp=2_500))


@named(f"with {LOG} select p, o, v from log")
def load_with_tail(spark, d):
    """The second snapshot, with the records that came after it as a tail."""
    engine = _made(spark, d, _history)
    return _pov(engine.load("events", as_of=2, tail=source.events_log(spark, d)))


@named(f"with {_HALF} select (o >= half) as in_stream, count(*) as n, count(distinct (p, o)) as distinct_n from x group by 1")
def views_split(spark, d):
    engine = _made(spark, d, _history)
    both = _pov(engine.load("events", "stream")).withColumn("in_stream", F.lit(True)).unionByName(_pov(engine.load("events", "lake")).withColumn("in_stream", F.lit(False)))
    return both.groupBy("in_stream").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct("p", "o")).alias("distinct_n"))


@named(f"with {_HALF} select p, o, v from x where o < half and o % 10 <> 3")
def history_deletes(spark, d):
    """The history without the positions that another engine deleted, some of them twice."""
    lake = _pov(_made(spark, d, _history).load("events", "lake")).withColumns({"file": F.col("p"), "pos": F.col("o")})
    gone = lake.where("o % 10 = 3").select("file", "pos")
    return tiering.without_deleted(lake, gone.unionByName(gone)).select("p", "o", "v")


@named(f"with {_HALF}, m as (select p, max(o) + 1 as e, count(*) as n, sum(sz) as b from log group by p) select 'events' as topic, sum(case when p % 2 = 0 then 10 else 0 end)::bigint as lag, sum(n)::bigint as records, sum(b)::bigint as bytes from m")
def lag_ranking(spark, d):
    """Records that a table lacks to its topic's stable ends; a stable end behind the table counts nothing."""
    engine = _made(spark, d, _history)
    stable = engine.partitions("events").select(F.lit("events").alias("topic"), "partition", (F.col("end") + F.when(F.col("partition") % 2 == 0, 10).otherwise(-5)).alias("stable"))
    return engine.overview(stable)


@named(f"""with {_HALF}, y as (select (o >= half)::int as spec, case when o < half then cast(floor(ms / 3600000.0) as int) else cast(floor(ms / 86400000.0) as int) end as bucket from x)
    select spec, count(*) as records, count(distinct bucket) as buckets, min(bucket) as low, max(bucket) as high from y group by spec""")
def spec_evolution(spark, d):
    """Files of two partition specs of one table: hours first, then days; both are read together by view_merged's path."""
    engine = _made(spark, d, _specs)
    f = engine.files("events").groupBy("spec")
    return f.agg(F.sum("records").alias("records"), F.countDistinct("bucket").alias("buckets"), F.min("bucket").alias("low"), F.max("bucket").alias("high"))


@named(f"with {LOG} select p, o, v from log")
def specs_read_together(spark, d):
    return _pov(_made(spark, d, _specs).load("events"))


@named("select 'lineitem' as topic, count(*) as files, sum(n)::bigint as records from (select l_orderkey % 2 as p, date_trunc('month', l_shipdate) as m, count(*) as n from lineitem group by all)")
def month_files(spark, d):
    """Files and records of a table with month buckets: one file for each month and partition."""
    f = _made(spark, d, _typed).files("lineitem")
    return f.agg(F.lit("lineitem").alias("topic"), F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"))


def _month() -> dict[str, pruning.Domain]:
    import datetime as dt

    return {"l_shipdate": pruning.Domain(((dt.datetime(1996, 1, 1), dt.datetime(1996, 2, 1), True, False),))}


@named("select 2 as files_most, true as within, l_orderkey, l_linenumber, l_quantity::double as l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-02-01'")
def pruned_by_column(spark, d):
    """A month of a typed column, read from the files whose bounds allow it: at most one for each partition."""
    engine = _made(spark, d, _typed)
    files = engine.matching("lineitem", engine.files("lineitem"), _month()).count()
    some = engine.load("lineitem", domains=_month()).where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-02-01'")
    return some.select(F.lit(2).alias("files_most"), F.lit(files <= 2).alias("within"), "l_orderkey", "l_linenumber", "l_quantity")


@named("select l_returnflag, count(*) as n, sum(l_quantity::decimal(18,2))::double as quantity from lineitem where l_shipdate < timestamp '1997-01-01' group by 1")
def sql_console(spark, d):
    """SQL over the engine's registered view of a typed table."""
    _made(spark, d, _typed).register("lineitem")
    return spark.sql("select l_returnflag, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from merged_lineitem where l_shipdate < timestamp_ntz'1997-01-01' group by 1")


@named(f"with {_HALF} select 3 as snapshots, (select count(*) from log) as records, (select count(distinct p) from log) as partitions, (select sum(half)::bigint from cut) as tiered")
def committed_snapshots(spark, d):
    """What three commits left: snapshots, records and partitions of the last one, offsets below the history's ends."""
    engine = _made(spark, d, _history)
    last = engine.offsets("events").where("id = 3")
    tiered = sum(engine.table("events")["history"]["ends"].values())
    n = engine.snapshots("events").agg(F.count(F.lit(1)).cast("int").alias("snapshots"))
    return n.crossJoin(last.agg(F.sum(F.col("end") - F.col("start")).alias("records"), F.count(F.lit(1)).alias("partitions"))).withColumn("tiered", F.lit(tiered).cast("long"))


# -- wire and payload formats -----------------------------------------------------------------------


def _packed_log(spark, d):
    """partition, data: the log in batches of 64 records, some compressed."""
    log = source.events_log(spark, d)
    rows = log.select(F.col("_kafka_partition").alias("partition"), F.expr("_kafka_offset div 64").alias("no"), F.struct(F.col("_kafka_offset").alias("o"), source.millis(F.col("_kafka_timestamp")).alias("ms"), F.col("_kafka_key").alias("k"), F.col("_kafka_value").alias("v")).alias("r"))
    groups = rows.groupBy("partition", "no").agg(F.sort_array(F.collect_list("r")).alias("rows"))  # 64 records at most

    def pack(found):
        for b in found:
            data = []
            for no, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data.append(batches.packed(rows[0]["o"], [(r["ms"], r["k"], r["v"]) for r in rows], ("none", "gzip", "zstd")[no % 3]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["partition", "data"])

    return groups.mapInArrow(pack, "partition int, data binary")


@named(f"with {LOG} select p, o, ms, k, v from log")
def batches_decoded(spark, d):
    """The log's record batches, uncompressed and compressed, as rows."""
    rows = batches.unpacked(_packed_log(spark, d))
    return rows.select(
        F.col(rows.columns[0]).alias("p"), F.col(rows.columns[1]).alias("o"), F.col(rows.columns[2]).cast("long").alias("ms"), F.col(rows.columns[3]).cast("string").alias("k"), F.col(rows.columns[4]).cast("string").alias("v")
    )


_AVRO = {"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string"}, {"name": "value", "type": "double"}, {"name": "props", "type": ["null", "string"]}]}


def _zigzag(n: int) -> bytes:
    return batches._varint(n)


def _payloads(spark, d, write):
    """event_id and the payload that write makes of each event; every hundredth is cut short."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value", "props")

    def run(found):
        for b in found:
            data = [write(*r)[: -1 if r[0] % 100 == 7 else None] for r in zip(*(b.column(k).to_pylist() for k in range(4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "payload"])

    return e.mapInArrow(run, "id long, payload binary")


def _avro_bytes(i, kind, value, props) -> bytes:
    text = lambda s: _zigzag(len(s.encode())) + s.encode()
    return _zigzag(i) + text(kind) + struct.pack("<d", value) + (_zigzag(0) if props is None else _zigzag(1) + text(props))


@named("""select event_id as id, event_id % 100 <> 7 as decoded, case when event_id % 100 <> 7 then event_type end as event_type, case when event_id % 100 <> 7 then floor(value)::bigint end as whole,
    case when event_id % 100 <> 7 then props end as props from events""")
def decoded_avro(spark, d):
    """Avro payloads as columns; payloads that are cut short stay raw."""
    out = decode.decoded(_payloads(spark, d, _avro_bytes), "payload", lambda: decode.Avro(_AVRO))
    c = out.select("id", F.col("raw").isNull().alias("decoded"), "decoded.event_type", F.floor("decoded.value").alias("whole"), "decoded.props")
    return c


def _protobuf_set() -> bytes:
    from google.protobuf import descriptor_pb2 as pb

    f = pb.FileDescriptorProto(name="e.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="Event")
    for name, number, kind in (("event_id", 1, 3), ("event_type", 2, 9), ("value", 3, 1), ("props", 4, 9)):
        m.field.add(name=name, number=number, type=kind, label=1)
    return pb.FileDescriptorSet(file=[f]).SerializeToString()


def _plain_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _protobuf_bytes(i, kind, value, props) -> bytes:
    text = lambda tag, s: bytes([tag]) + _plain_varint(len(s.encode())) + s.encode()
    return b"\0\x08" + _plain_varint(i) + text(0x12, kind) + b"\x19" + struct.pack("<d", value) + text(0x22, props or "")


try:
    import google.protobuf.descriptor_pb2  # noqa: F401
except ImportError:
    pass
else:

    @named("""select event_id as id, event_id % 100 <> 7 as decoded, case when event_id % 100 <> 7 then event_type end as event_type, case when event_id % 100 <> 7 then floor(value)::bigint end as whole,
        case when event_id % 100 <> 7 then props end as props from events""")
    def decoded_protobuf(spark, d):
        """Protobuf payloads as columns; payloads that are cut short stay raw."""
        spec = _protobuf_set()
        out = decode.decoded(_payloads(spark, d, _protobuf_bytes), "payload", lambda: decode.Protobuf(spec, "t.Event"))
        return out.select("id", F.col("raw").isNull().alias("decoded"), "decoded.event_type", F.floor("decoded.value").alias("whole"), "decoded.props")


@named("""select 'int' as kind, hex(from_hex('05000000')) as bytes union all select 'long', 'FFFFFFFFFFFFFFFF' union all select 'string', hex('ab') union all select 'date', '01000000' union all select 'decimal', '80'""")
def single_values(spark, d):
    """Bounds in their single-value binary form."""
    import datetime as dt
    from decimal import Decimal

    values = [("int", 5, T.IntegerType()), ("long", -1, T.LongType()), ("string", "ab", T.StringType()), ("date", dt.date(1970, 1, 2), T.DateType()), ("decimal", Decimal("-1.28"), T.DecimalType(9, 2))]
    return spark.createDataFrame([(k, encoding.encoded(v, t).hex().upper()) for k, v, t in values], "kind string, bytes string")


# -- names, pages, backfill -------------------------------------------------------------------------


@named(f"""with {FILES} select 'a.b/data/p=' || partition || '/' || start || '-' || "end" || '.t' || spec || '_' || bucket || '.s' || schema || '.v1.parquet' as path, partition, start, "end", bucket, true as same from files""")
def parsed_paths(spark, d):
    """File names that state partition, range, bucket and schema, written and read back."""
    f = demo.files(spark, d).select("partition", "start", "end", "spec", "bucket", "schema")

    def run(found):
        for b in found:
            rows = []
            for p, s, e, spec, bucket, schema in zip(*(b.column(k).to_pylist() for k in range(6))):
                text = f"a.b/data/p={p}/{s}-{e}.t{spec}_{bucket}.s{schema}.v1.parquet"
                back = paths.parse(text)
                rows.append((text, p, s, e, bucket, back is not None and back.path() == text))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "partition", "start", "end", "bucket", "same"])

    return f.mapInArrow(run, "path string, partition int, start long, end long, bucket int, same boolean")


@named("select c_custkey, '`' || replace(c_name, '`', '``') || '`' as quoted, chr(39) || c_name || chr(39) as text from customer")
def quoted_names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")

    def run(found):
        for b in found:
            names = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sqltext.identifier(n) for n in names]), pa.array([sqltext.literal(n) for n in names])], ["c_custkey", "quoted", "text"])

    return c.mapInArrow(run, "c_custkey long, quoted string, text string")
