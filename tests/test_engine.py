
import pytest

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.engine import Conflict, Engine
from tideframe.functions.placement import share
from tideframe.operators.pruning import Domain
from tideframe.sources.log import HEADERS, events_log

DAY = 86_400_000


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "w"))


def keys(df):
    return sorted((r["_kafka_partition"], r["_kafka_offset"]) for r in df.select("_kafka_partition", "_kafka_offset").collect())


def test_ingest_views_time_travel_and_tail(engine, spark, small):
    log = events_log(spark, small)
    engine.add_table("events", 4, file_bytes=1 << 12, file_window_ms=10 * DAY)
    first = engine.ingest("events", log.where("_kafka_offset < 100"), now_ms=1)
    second = engine.ingest("events", log.where("_kafka_offset >= 100 and _kafka_offset < 200"), now_ms=2)
    assert (first, second) == (1, 2)
    assert keys(engine.load("events")) == keys(log.where("_kafka_offset < 200"))
    assert keys(engine.load("events", as_of=1)) == keys(log.where("_kafka_offset < 100"))
    assert keys(engine.load("events", as_of_timestamp=1)) == keys(log.where("_kafka_offset < 100"))
    assert keys(engine.load("events", tail=log)) == keys(log)
    assert engine.load("events", "lake").count() == 0
    stable = {p: 250 for p in range(4)}
    assert engine.tail_id("events", stable) >= 1 << 62 and engine.tail_id("events", stable) == engine.tail_id("events", stable)
    assert engine.tail_id("events", {p: 200 for p in range(4)}) == 2
    with pytest.raises(Conflict):
        engine.store.write("events/snapshots/" + f"{2:020d}.json", "{}")
    # files of a snapshot tile its offsets
    ranges = engine.files("events").select("partition", "start", "end").distinct().orderBy("partition", "start").collect()
    for p in range(4):
        own = [(r.start, r.end) for r in ranges if r.partition == p]
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] == 200
    some = engine.load("events", domains={"_kafka_offset": Domain(((10, 20, True, True),))})
    assert set(keys(log.where("_kafka_offset between 10 and 20"))) <= set(keys(some)) and some.count() < engine.load("events").count()
    seen, at = [], None
    while True:
        page, at = engine.records_page("events", 1, at, limit=70)
        seen += [r._kafka_offset for r in page.collect()]
        if at is None:
            break
    assert seen == sorted(r._kafka_offset for r in log.where("_kafka_partition = 1 and _kafka_offset < 200").select("_kafka_offset").collect())
    middle = log.where("_kafka_partition = 1 and _kafka_offset = 150").first()._kafka_timestamp
    first = log.where((F.col("_kafka_partition") == 1) & (F.col("_kafka_timestamp") >= middle)).agg(F.min("_kafka_offset")).first()[0]
    assert engine.records_page("events", 1, timestamp=middle, limit=5)[0].first()._kafka_offset == first
    assert engine.records_page("events", 1, offset=10**9)[1] is None and engine.records_page("events", 77)[0].count() == 0
    engine.add_table("More", 1)
    assert engine.tables_page("merged", 1) == (["events"], "events") and engine.tables_page("merged", 1, "events") == (["more"], None)
    assert set(engine.capabilities()) == {"filter", "limit", "top_n"}
    assert (share(7, 3), share(6, 3), share(0, 3)) == (3, 2, 0)
    engine.register("events")
    rows, more = engine.sql("select count(*) as n from merged_events")
    assert rows[0].n == 800 and not more
    assert engine.profile("select _kafka_offset from stream_events where _kafka_offset > 5")[0]["pushed"]


def test_compaction_tiering_expiry_and_collection(engine, spark, small):
    log = events_log(spark, small).where("_kafka_offset < 120")
    engine.add_table("events", 4, file_bytes=1 << 10, file_window_ms=400 * DAY, granularity="month", tier_bytes=1 << 11)
    engine.ingest("events", log, now_ms=1)
    before = engine.files("events").count()
    late = 1 << 42
    done = engine.compact("events", late)
    assert done > 1
    live = engine.files("events").where("replaced is null")
    assert live.count() < before
    assert keys(engine.load("events")) == keys(log) == keys(engine.load("events", as_of=1))
    engine.attach("events", engine.warehouse + "/history")
    ends = engine.tier("events", late, ["day(_kafka_timestamp)"], ["_kafka_offset desc"])
    assert ends
    lake, stream, merged = (engine.load("events", v) for v in ("lake", "stream", "merged"))
    assert keys(merged) == keys(log)
    assert keys(lake) == sorted(k for k in keys(log) if k[1] < ends.get(k[0], 0))
    assert lake.count() + stream.count() == log.count()
    assert merged.select("_kafka_partition", "_kafka_offset").distinct().count() == merged.count()
    gone = engine.expire("events", late + 2 * DAY * 365)
    assert gone and engine.snapshots("events").count() == 1
    assert engine.collect("events")
    assert keys(engine.load("events")) == keys(log)


def test_tables(engine):
    t = engine.add_table("a", 2)
    with pytest.raises(Conflict):
        engine.add_table("a", 2)
    assert engine.list_tables() == ["a"]
    assert engine.set_granularity("a", "hour") == 0 and engine.set_granularity("a", "day") == 1
    assert engine.refresh("a", t["id"], 3) == "indexing" and engine.table("a")["partitions"] == 3
    with pytest.raises(ValueError):
        engine.refresh("a", t["id"], 1)
    assert engine.refresh("a", None) == "missing" and engine.refresh("a", "other") == "replaced"
    engine.remove_table("a")
    assert engine.refresh("a", t["id"], 3) == "removing" and engine.list_tables() == []
    engine.add_table("b", 1)
    engine.add_table("c", 1)
    engine.attach("b", "/x/y")
    with pytest.raises(ValueError):
        engine.attach("c", "/x/y/z")
    engine.detach("b")
    assert engine.attach("c", "/x/y/z") == 1
    assert engine.load("b").count() == 0


def test_broken_tiering_is_finished_or_undone(engine, spark, small):
    from tideframe.operators import tiering

    log = events_log(spark, small).where("_kafka_offset < 60")
    engine.add_table("events", 4, file_bytes=1 << 10, file_window_ms=400 * DAY, granularity="month")
    engine.ingest("events", log, now_ms=1)
    engine.attach("events", engine.warehouse + "/history")
    assert engine.recover_tier("events", 2) == {}
    planned = {p: 60 for p in range(4)}
    engine._change("events", tiering={str(p): e for p, e in planned.items()})
    tiering.write_history(log.where("_kafka_partition < 2"), engine.warehouse + "/history", [], [])
    assert engine.recover_tier("events", 3) == {} and keys(engine.load("events")) == keys(log)
    assert spark.read.parquet(engine.table("events")["history"]["location"]).count() == 0
    engine._change("events", tiering={str(p): e for p, e in planned.items()})
    tiering.write_history(log, engine.table("events")["history"]["location"], [], [])
    assert engine.recover_tier("events", 4) == planned
    assert engine.load("events", "stream").count() == 0 and keys(engine.load("events")) == keys(log)


def test_files_are_skipped_by_the_bounds_of_any_column(engine, spark):
    """3,600 records in 36 files of 3 partitions: the published shape of pruning before compaction."""
    rows = spark.range(3600).select(
        F.expr("id div 100 % 3").cast("int").alias("_kafka_partition"), F.expr("id div 300 * 100 + id % 100").alias("_kafka_offset"), F.timestamp_micros(F.col("id") * 12_000_000).cast("timestamp_ntz").alias("_kafka_timestamp"),
        F.lit(None).cast("binary").alias("_kafka_key"), F.array().cast(HEADERS).alias("_kafka_headers"), F.lit(b"x").alias("_kafka_value"), "id", F.when(F.col("id") % 100 != 7, F.col("id") % 1000).cast("double").alias("amount"),
    )
    engine.add_table("wide", 3, granularity="hour", file_bytes=100, file_window_ms=1 << 40)
    engine.ingest("wide", rows, now_ms=1)
    files = engine.files("wide")
    count = lambda **domains: engine.matching("wide", files, domains).count()
    assert files.count() == 36
    assert count(id=Domain(values=(1234,))) == 1
    assert count(id=Domain(((2000, 2400, True, True),))) == 5
    assert count(_kafka_partition=Domain(values=(1,)), id=Domain(((None, 600, True, False),))) == 2
    assert count(_kafka_partition=Domain(values=(1,))) == 12
    assert count(amount=Domain(((5000.0, None, False, True),))) == 0 and count(amount=Domain(null=True)) == 36
    some = engine.load("wide", domains={"id": Domain(((2000, 2400, True, True),))}).where("id between 2000 and 2400")
    assert some.count() == 401


def values(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_retention_moves_starts_and_collects_what_no_commit_names(engine, spark, small):
    log = events_log(spark, small).where("_kafka_offset < 120")
    engine.add_table("events", 4, file_bytes=1 << 10, file_window_ms=400 * DAY, granularity="month")
    engine.ingest("events", log, now_ms=1)
    starts = {p: sorted(r.start for r in engine.files("events").where(F.col("partition") == p).select("start").distinct().collect()) for p in range(4)}
    moved = engine.trim("events", {0: 30, 1: 0, 2: 10**6}, now_ms=2)
    assert moved == {0: min(s for s in starts[0] if s >= 30), 2: 120}
    left = [k for k in keys(log) if k[1] >= moved.get(k[0], 0)]
    assert keys(engine.load("events")) == left and keys(engine.load("events", as_of=1)) == keys(log)
    assert engine.trim("events", {0: 30}) == {}
    assert engine.collect("events") == []  # the first snapshot still reads everything
    engine.expire("events", 1 << 42)
    gone = engine.collect("events")
    assert gone and all("/partition=0/" in g or "/partition=2/" in g for g in gone)
    assert keys(engine.load("events")) == left
    # a write that broke off before its commit: not read, in nobody's way, and collected after the grace
    log.write.parquet(f"{engine.warehouse}/events/data/9-broken")
    spark.createDataFrame([], "a int").write.parquet(f"{engine.warehouse}/events/files/3-broken")
    more = events_log(spark, small).where("_kafka_offset >= 120 and _kafka_offset < 130")
    assert engine.ingest("events", more) == 3
    assert not any("broken" in g for g in engine.collect("events"))
    assert {"events/data/9-broken", "events/files/3-broken"} <= set(engine.collect("events", 1 << 42))
    assert keys(engine.load("events")) == sorted(left + keys(more))


def test_sketches_summaries_and_manifests_of_commits(engine, spark, small):
    log = events_log(spark, small)
    engine.add_table("events", 4, file_bytes=1 << 12, file_window_ms=400 * DAY, granularity="month")
    assert engine.distinct_counts("events").count() == 0
    engine.ingest("events", log.where("_kafka_offset < 100"), now_ms=1)
    engine.ingest("events", log.where("_kafka_offset >= 100"), now_ms=2)
    engine.compact("events", 1 << 42)
    n = {r.field: r.ndv for r in engine.distinct_counts("events").collect()}
    exact = log.agg(F.countDistinct("_kafka_key"), F.countDistinct("_kafka_offset"), F.countDistinct("_kafka_partition")).first()
    assert (n["_kafka_key"], n["_kafka_offset"], n["_kafka_partition"]) == tuple(exact)  # exact below the sketch's size
    first, second, third = (engine.summary("events", i).first() for i in (1, 2, 3))
    assert (first.operation, first.added_records, first.total_records) == ("append", 400, 400)
    assert (second.operation, second.added_records, second.deleted_files, second.total_records) == ("append", log.count() - 400, 0, log.count())
    assert third.operation == "overwrite" and third.total_records == log.count() and third.total_files < second.total_files
    assert engine.manifests("events").agg(F.sum("files")).first()[0] == third.total_files
    with pytest.raises(KeyError):
        engine.summary("events", 9)


def test_stable_ends_and_a_stream(engine, spark, small, tmp_path):
    log = events_log(spark, small)
    gaps = log.where("_kafka_offset % 10 <> 0 and _kafka_offset < 95")
    engine.add_table("gaps", 4, file_bytes=1 << 10, file_window_ms=400 * DAY, granularity="month")
    engine.ingest("gaps", gaps.where("_kafka_offset < 50"), stable={p: 50 for p in range(4)})
    engine.ingest("gaps", gaps.where("_kafka_offset >= 50"), stable={p: 100 for p in range(4)})
    assert keys(engine.load("gaps")) == keys(gaps)
    ranges = engine.files("gaps").select("partition", "start", "end").distinct().orderBy("partition", "start").collect()
    for p in range(4):
        own = [(r.start, r.end) for r in ranges if r.partition == p]
        assert own[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and any(b[0] == 50 for b in own)
    with pytest.raises(ValueError):
        engine.ingest("gaps", gaps.where("_kafka_offset < 50"), stable={p: 120 for p in range(4)})
    engine.add_table("live", 4, file_bytes=1 << 12, file_window_ms=400 * DAY, granularity="month")
    for low in (0, 100):
        log.where(f"_kafka_offset >= {low} and _kafka_offset < {low + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        engine.follow("live", str(tmp_path / "in"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
        assert keys(engine.load("live")) == keys(log.where(f"_kafka_offset < {low + 100}"))
    assert engine.table("live") and engine._latest("live")["mark"] == {str(tmp_path / "state"): 1}
    n = engine.snapshots("live").count()
    for name in ("1", ".1.crc"):  # the last batch is repeated, as after a failure
        (tmp_path / "state" / "commits" / name).unlink()
    engine.follow("live", str(tmp_path / "in"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    assert engine.snapshots("live").count() == n and keys(engine.load("live")) == keys(log.where("_kafka_offset < 200"))


def test_typed_columns_of_several_schemas(engine, spark, small):
    from tideframe.sources.decode import JsonSchema

    log = events_log(spark, small)
    old = JsonSchema({"type": "object", "properties": {"k": {"type": "integer"}}})
    new = JsonSchema({"type": "object", "properties": {"k": {"type": "integer"}, "more": {"type": "string"}}})
    engine.add_table("typed", 4, file_bytes=1 << 20, file_window_ms=400 * DAY, granularity="month")
    first = log.where("_kafka_offset < 40").withColumn("_kafka_value", F.when(F.col("_kafka_offset") % 5 == 0, F.lit(b"{")).otherwise(F.col("_kafka_value")))
    engine.ingest_typed("typed", first, lambda: old)
    second = log.where("_kafka_offset >= 40 and _kafka_offset < 60").withColumn("_kafka_value", F.lit(b'{"k": 7, "more": "m"}'))
    engine.ingest_typed("typed", second, lambda: new)
    want = values(first.where("_kafka_offset % 5 <> 0").selectExpr("_kafka_partition", "_kafka_offset", "cast(get_json_object(cast(_kafka_value as string), '$.k') as bigint)"), "*")
    loaded = engine.load("typed")
    assert values(loaded.where("_kafka_offset < 40 and _kafka_offset % 5 <> 0"), "_kafka_partition", "_kafka_offset", "k") == want
    assert loaded.where("_kafka_offset < 40 and _kafka_offset % 5 = 0 and k is null and _kafka_value is not null and more is null").count() == 32
    assert loaded.where("_kafka_offset >= 40 and more = 'm' and k = 7 and _kafka_value is null").count() == 80
    before = values(loaded, "_kafka_partition", "_kafka_offset", "k", "more")
    engine.compact("typed", 1 << 42)
    assert values(engine.load("typed"), "_kafka_partition", "_kafka_offset", "k", "more") == before
    with pytest.raises(ValueError):
        engine.ingest("typed", log.where("_kafka_offset >= 60").withColumn("k", F.lit("text")))
    assert values(engine.load("typed"), "_kafka_partition", "_kafka_offset", "k", "more") == before


def test_registry_histories_and_removal(engine, spark, small):
    from pyspark.sql import types as T
    from tideframe.operators.schema import Rejected

    kind = T.StructType([T.StructField("n", T.IntegerType())])
    engine.add_schema("1", kind, "events-value")
    engine.add_schema("2", kind, None, ["1", "9"])
    engine.add_schema("1", T.StructType(), "other-key")
    known = Engine(spark, engine.warehouse).registry()
    assert known.resolve("1", "events") == kind == known.resolve("1", "other", "key")
    assert known.resolve("1", "other") == Rejected("not_accepted", "1") and known.resolve("2", "events") == Rejected("missing", "9")
    log = events_log(spark, small).where("_kafka_offset < 40")
    engine.add_table("events", 4, file_bytes=1 << 20, file_window_ms=400 * DAY, granularity="month")
    engine.ingest("events", log, now_ms=1)
    assert engine.list_tables() == ["events"]
    spark.range(3).write.parquet(f"{engine.warehouse}/odd")
    with pytest.raises(ValueError, match="schema differs"):
        engine.attach("events", f"{engine.warehouse}/odd")
    ends = {r.partition: r.end for r in engine.partitions("events").collect()}
    log.write.parquet(f"{engine.warehouse}/h1")
    engine.attach("events", f"{engine.warehouse}/h1", ends)
    more = events_log(spark, small).where("_kafka_offset >= 40 and _kafka_offset < 50")
    engine.ingest("events", more, now_ms=2)
    assert engine.load("events", "lake").count() == 160
    engine.detach("events")
    assert engine.load("events", "lake", as_of=2).count() == 160
    assert engine.attach("events", f"{engine.warehouse}/h2") == 2
    assert engine.snapshots("events").count() == 1 and keys(engine.load("events")) == keys(log.unionByName(more))
    engine.remove_table("events", now_ms=10)
    assert engine.purge(20) == [] and engine.purge(1 << 42) == ["events"] and engine.list_tables(None) == []


def test_commit_spreads_a_large_file(engine, spark, small):
    """The rows of one file are written by several tasks once they are many, its sketches too; nothing is lost."""
    log = events_log(spark, small)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    small_parts = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in small_parts}
    engine.add_table("events", 4, granularity="month", file_window_ms=400 * DAY)
    try:
        for k, v in small_parts.items():
            spark.conf.set(k, v)
        engine.ingest("events", log.repartition(8), now_ms=1)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split
    files = engine.files("events").collect()
    assert len(files) == 4 and sum(f.records for f in files) == 1000
    parts = [n for f in files for n in engine.store.list(f.location) if n.endswith(".parquet")]
    assert len(parts) > 8
    assert len([n for n in engine.store.list("events/sketches/" + engine.store.list("events/sketches")[0]) if n.endswith(".parquet")]) > 1
    assert keys(engine.load("events")) == keys(log)


def test_numbered_in_ranges(spark, small, tmp_path, monkeypatch):
    """Places in a sorted order, counted range by range: those of one window over all rows, and no task reads a whole partition."""
    from tideframe.plans import tables

    monkeypatch.setattr(tables, "_RANGE_ROWS", 500)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").withColumn("k", F.pmod("l_orderkey", F.lit(2)))
    order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    got = tables._numbered(rows, str(tmp_path / "n"), "k", order)
    want = rows.withColumn("_kafka_offset", (F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1).cast("long"))
    some = lambda df: sorted(map(tuple, df.select("k", "_kafka_offset", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").collect()))
    assert some(got) == some(want)
    most = spark.read.parquet(str(tmp_path / "n")).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < rows.count() // 4


def test_stream_input_is_written_by_every_task(spark, small, tmp_path, monkeypatch):
    """Each third of the log is written as it is read, not by one task, and is one commit; nothing is lost."""
    from tideframe.plans.catalogue import QUERIES

    spark.read.parquet(f"{small}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    found, real = [], Engine.follow

    def follow(self, topic, path, *rest, **more):
        found.append(len(spark.read.parquet(path).inputFiles()))
        return real(self, topic, path, *rest, **more)

    monkeypatch.setattr(Engine, "follow", follow)
    got = QUERIES["stream_ingest_counts"](spark, str(tmp_path))
    assert found == [4, 8, 12]  # three files in all before
    assert sorted(tuple(r) for r in got.collect()) == [(p, 250, 0, 249) for p in range(4)]
