"""Operators of the log-table engine against plain Python, with seeded random data."""

import datetime as dt
import decimal
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions import buckets, render, wire
from tideframe.operators import grouping, paths, planning, pruning, schema, stats, tiering
from tideframe.plans import control
from tideframe.sources import decode, log

MS = 86_400_000


def test_buckets(spark):
    rng = random.Random(1)
    times = [-1, 0, -3_600_000, 1 << 42, *(rng.randrange(-(10**13), 10**13) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in times], "ms long")
    for grain in ("hour", "day", "month"):
        b = buckets.bucket(F.col("ms"), grain)
        out = df.select("ms", b.alias("b")).select("ms", "b", buckets.bucket_end_ms(F.col("b"), grain).alias("e")).collect()
        for r in out:
            day = dt.date(1970, 1, 1) + dt.timedelta(days=r.ms // MS)
            want = {"hour": r.ms // 3_600_000, "day": r.ms // MS, "month": (day.year - 1970) * 12 + day.month - 1}[grain]
            assert r.b == want and r.e > r.ms
    assert df.select(buckets.bucket(F.col("ms"), "none").alias("b")).where("b is not null").count() == 0
    with pytest.raises(ValueError):
        buckets.bucket(F.col("ms"), "week")


def test_wire_headers(spark):
    guid = bytes(range(16))
    by_header = [("__value_schema_id", b"\x01" + guid + b"ab"), ("other", b"x")]
    rows = [
        (b"\x00\x00\x00\x01\x02body", []), (b"\x03\x05" + guid + b"z", []), (b"\x03\x07" + guid, []), (b"\x00\x01", []), (b"pay", by_header), (None, by_header),
        (b"\x00\x00\x00\x00\x07x", [("__value_schema_id", b"\x01short")]), (None, []),
    ]
    df = spark.createDataFrame(rows, "p binary, h array<struct<key:string,value:binary>>")
    got = [(r.w.kind, r.w.id, r.w.compressed, None if r.w.body is None else bytes(r.w.body)) for r in df.select(wire.wire_header(F.col("p"), F.col("h")).alias("w")).collect()]
    assert got == [
        ("id", "258", False, b"body"), ("uuid", guid.hex(), True, b"z"), (None, None, False, b"\x03\x07" + guid), (None, None, False, b"\x00\x01"),
        ("guid", guid.hex(), False, b"abpay"), ("guid", guid.hex(), False, b"ab"), ("id", "7", False, b"x"), (None, None, False, None),
    ]
    import zlib

    df = spark.createDataFrame([(zlib.compress(b"hello" * 9),), (b"junk",), (None,)], "b binary")
    assert [None if r.x is None else bytes(r.x) for r in df.select(wire.inflate("b").alias("x")).collect()] == [b"hello" * 9, None, None]


def test_bounds(spark):
    texts = ["", "a" * 16, "a" * 17, "b" * 15 + "\U0010ffff" + "c", "\U0010ffff" * 17, "é" * 20, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(render.lower_bound(F.col("t")).alias("l"), render.upper_bound(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == ["", "a" * 16, "a" * 15 + "b", "b" * 14 + "c", None, "é" * 15 + "ê", None]
    for t, r in zip(texts, got):
        assert t is None or r.l <= t and (r.u is None or r.u >= t)


def groups_of(rows, most, window):
    """Cut a list of (ts, size, bucket) by hand."""
    out, no, open_ = [], 0, []
    for ts, size, b in rows:
        if open_ and b is not None and b > max(x[2] for x in open_):
            no, open_ = no + 1, []
        open_.append((ts, size, b))
        out.append(no)
        if sum(x[1] for x in open_) >= most or ts - open_[0][0] >= window:
            no, open_ = no + 1, []
    return out


def test_file_groups(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for p in range(3):
        ts, own = 0, []
        for o in range(300):
            ts += rng.randrange(-50, 100)
            own.append((ts, rng.randrange(1, 50), ts // 500))
            rows.append((p, o * 2, *own[-1]))
        want |= {(p, o * 2): g for o, g in enumerate(groups_of(own, 400, 900))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "partition int, offset long, ts_ms long, size long, bucket int").repartition(5)
    grouped = grouping.file_groups(df, 400, 900)
    assert {(r.partition, r.offset): r.group for r in grouped.collect()} == want
    ranges = grouping.group_ranges(grouped).orderBy("partition", "group").collect()
    for p in range(3):
        own = [r for r in ranges if r.partition == p]
        assert own[0].start == 0 and own[-1].end == 599 and own[-1].last and all(a.end == b.start and not a.last for a, b in zip(own, own[1:]))
    pieces = grouping.bucket_files(df.join(grouping.group_ranges(grouped).select("partition", "start", "end"), "partition").where("offset >= start and offset < end"))
    assert pieces.agg(F.sum("records")).first()[0] == 900


@pytest.mark.parametrize("case", ["rising", "late", "none", "some null"])
def test_file_ranges(spark, case):
    """Ranges as cut by hand, whatever the buckets; stretches between rising buckets do not meet in one task."""
    rng = random.Random(case)
    rows, want = [], []
    for p in range(2):
        own, ts = [], 0
        for o in range(600):
            ts += rng.randrange(0, 60) if case == "rising" else rng.randrange(-400, 440) if rng.random() < 0.1 else rng.randrange(0, 50)
            b = None if case == "none" or case == "some null" and rng.random() < 0.2 else ts // 1000
            own.append((ts, rng.randrange(1, 50), b))
        if case == "some null":
            own = [x if x[2] is None else (*x[:2], 0) for x in own]
        numbers = groups_of([(t, z, -(1 << 40) if b is None else b) for t, z, b in own], 700, 900) if case != "some null" else [g for g in _one_by_one(own, 700, 900)]
        starts = [3 * numbers.index(g) for g in range(numbers[-1] + 1)]
        want += [(p, g, s, e, g == numbers[-1]) for g, (s, e) in enumerate(zip(starts, [*starts[1:], 3 * 599 + 1]))]
        rows += [(p, 3 * o, *x) for o, x in enumerate(own)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "partition int, offset long, ts_ms long, size long, bucket int").repartition(5)
    assert sorted(grouping.file_ranges(df, 700, 900)) == want
    some = grouping.in_ranges(df, [(p, s, e, g) for p, g, s, e, _ in want], "no long")
    assert some.count() == len(rows)
    if case == "rising":
        buckets_met = len({(r[0], r[4]) for r in rows})
        assert len(grouping._stretches(df, 700, 900)) == buckets_met  # a task folded a whole partition before
        assert grouping.file_groups(df, 1 << 40, 1 << 40).select("partition", "group").distinct().count() == buckets_met


def _one_by_one(rows, most, window):
    g = grouping.Grouper(most, window)
    return [g.add(*r) for r in rows]


def test_whole_stretches_are_not_folded(spark, monkeypatch):
    """Where nothing can end a group within a bucket, no record is read again."""
    df = spark.createDataFrame([(p, o, o * 10, 5, o // 100) for p in range(2) for o in range(500)], "partition int, offset long, ts_ms long, size long, bucket int")
    monkeypatch.setattr(grouping, "_folded", None)
    assert grouping.file_ranges(df, 1000, 2000) == [(p, g, g * 100, g * 100 + 100, g == 4) for p in range(2) for g in range(5)]


def test_read_committed(spark):
    rng = random.Random(3)
    batches, aborted, markers, want = [], [], [], set()
    for p in range(2):
        open_at, pending = {}, {}
        for o in range(400):
            r, kind = rng.randrange(4), rng.random()
            if kind < 0.1:
                commit = rng.random() < 0.5
                batches.append((p, o, r, True, True))
                if r in open_at:
                    if commit:
                        want |= {(p, x) for x in pending.pop(r)}
                    else:
                        aborted.append((p, r, open_at[r]))
                        markers.append((p, r, o))
                        pending.pop(r)
                    del open_at[r]
            elif kind < 0.4:
                batches.append((p, o, r, False, False))
                want.add((p, o))
            else:
                batches.append((p, o, r, True, False))
                open_at.setdefault(r, o)
                pending.setdefault(r, []).append(o)
        want |= {(p, x) for xs in pending.values() for x in xs}
    df = spark.createDataFrame(batches, "partition int, offset long, producer int, transactional boolean, control boolean")
    a, m = spark.createDataFrame(aborted, "partition int, producer int, first long"), spark.createDataFrame(markers, "partition int, producer int, offset long")
    assert {(r.partition, r.offset) for r in log.read_committed(df, a, m).collect()} == want


def test_statistics(spark):
    rows = [(1, 1.0, "abc", [1], (5, "x")), (1, float("nan"), None, [2], (6, None)), (1, None, "\U0010ffff" * 20, None, None), (2, 2.0, "z" * 20, [], (1, "y"))]
    df = spark.createDataFrame(rows, "f int, d double, s string, a array<int>, n struct<i:int,t:string>")
    got = {(r.f, r.field): tuple(r)[2:] for r in stats.column_stats(df, ["f"]).collect()}
    assert got[1, "d"] == (3, 1, 1, "1.0", "1.0")
    assert got[1, "s"] == (3, 1, None, None, None)
    assert got[2, "s"] == (1, 0, None, "z" * 16, "z" * 15 + "{")
    assert got[1, "a"] == (3, 1, None, None, None) and got[1, "n.i"] == (3, 1, None, "5", "6") and got[1, "n.t"][1] == 2
    assert {r.lower for r in stats.column_stats(df, ["f"], mode="counts").collect()} == {None}
    with pytest.raises(ValueError):
        stats.column_stats(df, ["f"], mode="some")
    many = spark.range(30_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 20_000).alias("v"))
    n = stats.distinct_counts(stats.sketches(many, F.col("day"), ["v"])).first().ndv
    assert abs(n - 20_000) < 1_000


def test_merged_statistics_compare_values(spark):
    rows = [(1, "n", 5, 0, None, "9", "20"), (2, "n", 5, 0, None, "10", "100"), (1, "s", 5, 0, None, "9", "20"), (2, "s", 5, 0, None, "10", "100"), (1, "d", 4, 0, None, "1", None), (2, "d", 4, 0, None, "2", "3")]
    parts = spark.createDataFrame(rows, "f int, field string, rows long, nulls long, nans long, lower string, upper string")
    kinds = T.StructType.fromDDL("n long, s string, d double")
    got = {r.field: (r.rows, r.lower, r.upper) for r in stats.merged_stats(parts, ["field"], kinds).collect()}
    assert got == {"n": (10, "9", "100"), "s": (10, "10", "20"), "d": (8, None, None)}
    assert stats.merged_stats(parts.limit(0), ["field"], kinds).count() == 0


def test_paths():
    for p in ("a.b/data/p=0/0-1.t0.s0.v1.parquet", "t/data/p=2147483647/5-9.t3_-7.s12.a0123456789abcdef.v1.parquet"):
        assert paths.parse(p).path() == p
    for p in ("t/data/p=0/5-5.t0.s0.v1.parquet", "t/data/p=0/9-5.t0.s0.v1.parquet", "t/data/p=00/0-1.t0.s0.v1.parquet", "t/data/p=0/0-1.t0.s0.v9.parquet", "t/data/p=0/+0-1.t0.s0.v1.parquet", "t/x"):
        assert paths.parse(p) is None
    assert paths.assembly_hash([(0, 5), (5, 9)]) == hashlib.sha256(b"0:5\n5:9\n").hexdigest()[:16]
    assert paths.tail_snapshot_id([(1, 0, 5), (0, 2, 3)]) == paths.tail_snapshot_id([(0, 2, 3), (1, 0, 5)]) >= 1 << 62


def test_schema_merge(spark):
    f = schema.field
    s1 = schema.merge(T.StructType(), T.StructType([f("id", T.LongType()), f("n", T.StructType([f("a", T.IntegerType())])), f("l", T.ArrayType(T.StringType()))]), 1)
    assert [x.metadata["id"] for x in s1.fields] == [10, 11, 12]
    s2 = schema.merge(s1, T.StructType([f("id", T.IntegerType()), f("n", T.StructType([f("a", T.LongType()), f("b", T.StringType())])), f("l", T.ArrayType(T.StringType()))]), 2)
    assert s2["id"].dataType == T.LongType() and [x.name for x in s2["n"].dataType.fields] == ["a", "b"]
    s3 = schema.merge(s2, T.StructType([f("key", T.LongType(), aliases=("id",)), f("l", T.LongType())]), 3)
    assert [x.name for x in s3.fields] == ["key", "n", "l_s3", "l"]
    assert s3["key"].metadata["id"] == 10 and s3["l_s3"].metadata["id"] == s1["l"].metadata["id"]
    numbers = [x.metadata["id"] for x in s3.fields]
    assert len(set(numbers)) == len(numbers)
    assert schema.merge(s3, T.StructType([f("_kafka_offset", T.LongType())]), 4).reason == "reserved_name"
    deep = T.StringType()
    for _ in range(70):
        deep = T.StructType([f("x", deep)])
    assert schema.merge(T.StructType(), T.StructType([f("d", deep)]), 1).reason == "unsupported"
    assert schema.widened(T.DecimalType(9, 2), T.DecimalType(12, 2)) == T.DecimalType(12, 2) and schema.widened(T.DecimalType(9, 2), T.DecimalType(12, 3)) is None
    r = schema.Registry()
    r.add("1", s1, "t-value", ["2"])
    assert r.resolve("1", "t").reason == "missing"
    r.add("2", s2)
    assert r.resolve("1", "t") == s1 and r.resolve("2", "t").reason == "not_accepted"


def test_types_and_tables_widen_apart():
    """One rule for a field's type and one for a table's columns, under names of their own."""
    i, n, f, d, s = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()
    for old, new, want in ((i, n, n), (n, i, n), (f, d, d), (d, f, d), (i, i, i), (i, s, None), (n, d, None)):
        assert schema.widened(old, new) == want
    got = schema.widened_columns(T.StructType().add("a", i).add("b", d), T.StructType().add("c", s).add("b", f).add("a", n))
    assert [(x.name, x.dataType) for x in got] == [("a", n), ("b", d), ("c", s)]
    with pytest.raises(ValueError, match="changes from int to string"):
        schema.widened_columns(T.StructType().add("a", i), T.StructType().add("a", s))


def test_schemas_only_grow():
    rng = random.Random(4)
    kinds = [T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()]
    table = T.StructType()
    for version in range(1, 40):
        writer = T.StructType([schema.field(n, rng.choice(kinds)) for n in rng.sample("abcdefgh", rng.randint(1, 6))])
        after = schema.merge(table, writer, version)
        before = {f.metadata["id"] for f in table.fields}
        assert before <= {f.metadata["id"] for f in after.fields} and len({f.name for f in after.fields}) == len(after.fields)
        for w in writer.fields:  # a writer's field is never narrower than its column
            assert schema.widened(after[w.name].dataType, w.dataType) == after[w.name].dataType
        table = after


# -- decoders ---------------------------------------------------------------------------------------


def zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def avro_string(s):
    b = s.encode()
    return zigzag(len(b)) + b


def test_avro(spark):
    spec = {
        "type": "record", "name": "R", "namespace": "x", "fields": [
            {"name": "b", "type": "boolean"}, {"name": "i", "type": "int"}, {"name": "f", "type": "float"}, {"name": "s", "type": ["null", "string"]},
            {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "a", "type": {"type": "array", "items": "long"}},
            {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
            {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "u", "type": ["int", "string"]},
            {"name": "r", "type": ["null", "R"]}, {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        ],
    }
    body = (
        b"\x01" + zigzag(-5) + struct.pack("<f", 1.5) + zigzag(1) + avro_string("hé") + zigzag(1) + zigzag(2) + zigzag(7) + zigzag(-8) + zigzag(0)
        + zigzag(1) + avro_string("k") + zigzag(3) + zigzag(0) + zigzag(2) + (12345).to_bytes(2, "big") + zigzag(1000) + zigzag(0) + zigzag(42) + zigzag(0) + zigzag(1)
    )
    a = decode.Avro(spec)
    v = a.decode(body)
    assert v["i"] == -5 and v["s"] == "hé" and v["e"] == "B" and v["a"] == [7, -8] and v["m"] == [("k", 3)] and v["d"] == decimal.Decimal("123.45")
    assert v["u"] == '{"int":42}' and v["r"] is None
    assert v["day"] == dt.date(1970, 1, 2)
    for broken in (body[:-1], body + b"\0", b""):
        with pytest.raises(decode.Undecodable):
            a.decode(broken)
    df = spark.createDataFrame([(1, body), (2, body + b"\0"), (3, None)], "k int, v binary")
    got = decode.decoded(df, "v", lambda: decode.Avro(spec)).orderBy("k").collect()
    assert got[0].decoded.u == '{"int":42}' and got[0].raw is None and got[1].decoded is None and bytes(got[1].raw) == body + b"\0" and got[2].decoded is None and got[2].raw is None


def test_json_schema(spark):
    spec = {
        "type": "object", "properties": {
            "i": {"type": "integer"}, "d": {"type": "string", "format": "date-time"}, "m": {"type": "object", "additionalProperties": {"type": "integer"}},
            "u": {"oneOf": [{"type": "integer"}, {"type": "string"}]}, "n": {"type": ["null", "number"]}, "ref": {"$ref": "#/definitions/p"},
        }, "definitions": {"p": {"type": "object", "properties": {"x": {"type": "boolean"}}}},
    }
    j = decode.JsonSchema(spec)
    v = j.decode(b'{"i":1,"d":"2024-01-02T03:04:05.5+01:00","m":{"b":2,"a":1},"u":{"z":1,"a":[2]},"n":3,"ref":{"x":true},"extra":0}')
    assert v["i"] == 1 and v["d"] == dt.datetime(2024, 1, 2, 2, 4, 5, 500000, dt.timezone.utc) and v["m"] == [("a", 1), ("b", 2)] and v["u"] == '{"a":[2],"z":1}' and v["ref"] == {"x": True}
    assert j.decode(b"{}") == {k: None for k in ("i", "d", "m", "u", "n", "ref")}
    for broken in (b'{"i":"1"}', b'{"i":9223372036854775808}', b'{"i":true}', b'{"d":"x"}', b"[", b"[]", b'{"ref":{"x":1}}'):
        with pytest.raises(decode.Undecodable):
            j.decode(broken)


def test_protobuf():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    f = pb.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="M")
    for name, number, kind, label in (("i", 1, 5, 1), ("u", 2, 4, 1), ("s", 3, 9, 1), ("l", 4, 3, 3)):
        m.field.add(name=name, number=number, type=kind, label=label)
    f.message_type.add(name="Other").field.add(name="x", number=1, type=5, label=1)
    d = decode.Protobuf(pb.FileDescriptorSet(file=[f]).SerializeToString(), "t.M")
    body = b"\x08\x07\x10" + b"\xff" * 9 + b"\x01" + b"\x1a\x02hi" + b"\x22\x02\x01\x02"
    assert d.decode(b"\0" + body) == {"i": 7, "u": decimal.Decimal(2**64 - 1), "s": "hi", "l": [1, 2]}
    assert d.column_type()["u"].dataType == T.DecimalType(20, 0)
    for broken in (zigzag(1) + zigzag(1) + body, b"\0\x08"):
        with pytest.raises(decode.Undecodable):
            d.decode(broken)


def test_routing(spark):
    df = spark.createDataFrame([(None, "s1"), ("x", None), ("x", "s1")], "v string, schema_id string")
    assert [r.route for r in decode.routed(df, "v", ["s1"]).collect()] == ["null", "raw", "columns"]
    with pytest.raises(Exception, match="never merged"):
        decode.routed(df, "v", []).collect()


# -- planning ---------------------------------------------------------------------------------------

FILE = "partition int, start long, end long, spec int, bucket int, schema int, records long, bytes long, first_ts_ms long, added long, replaced long"


def some_files(rng, n=60):
    rows = []
    for p in range(3):
        at = 0
        for _ in range(n):
            end = at + rng.randint(1, 9)
            for b in sorted(rng.sample(range(4), rng.choice([1, 1, 2]))):
                rows.append((p, at, end, 0, b, 0, rng.randint(1, 5), rng.randint(10, 300), at * 10 + b, rng.randint(1, 5), rng.choice([None, None, 4])))
            at = end
    return rows


def test_assembly_runs(spark):
    rows = some_files(random.Random(5))
    got = {(r.partition, r.bucket, r.start, r.end, r.files, r.bytes) for r in planning.assembly_runs(spark.createDataFrame(rows, FILE), 500, F.col("bucket") < 3).collect()}
    want = set()
    for p in range(3):
        for b in range(3):
            run = []
            for r in [*sorted(x for x in rows if x[0] == p and x[4] == b), None]:
                if r is None or run and sum(x[7] for x in run) + r[7] > 500:
                    if len(run) > 1:
                        want.add((p, b, run[0][1], run[-1][2], len(run), sum(x[7] for x in run)))
                    run = []
                if r:
                    run.append(r)
    assert got == want


def test_tier_plans_end_between_files(spark):
    rows = some_files(random.Random(6))
    files, starts = spark.createDataFrame(rows, FILE), spark.createDataFrame([(p, 0) for p in range(3)], "partition int, start long")
    pieces = planning.tier_pieces(files, starts, 1500)
    segments = planning.tier_segments(pieces).orderBy("partition", "start").collect()
    assert segments and all(a.end == b.start for a, b in zip(segments, segments[1:]) if a.partition == b.partition)
    for r in segments:
        own = [x for x in rows if x[0] == r.partition]
        assert not any(x[1] < r.end < x[2] or x[1] < r.start < x[2] for x in own)
        inside = [x for x in own if x[1] >= r.start and x[2] <= r.end]
        assert all(x[8] < 1500 for x in inside) and r.bytes <= sum(x[7] for x in inside)
    flushes = planning.tier_flushes(pieces, 1 << 40, 700).orderBy("partition", "start").collect()
    assert sum(f.bytes for f in flushes) == sum(r.bytes for r in segments)
    for f in flushes:
        assert f.reads[0].start == f.start and f.reads[-1].end == f.end and all(a.end == b.start for a, b in zip(f.reads, f.reads[1:]))
    assert all(f.bytes >= 700 for f in planning.tier_flushes(pieces, -1, 700).collect())
    assert planning._reads([(0, 10, 100), (10, 12, 10), (12, 40, 95)], 40) == [(0, 4), (4, 8), (8, 10), (10, 12), (12, 22), (22, 32), (32, 40)]


def test_expiry_and_retention(spark):
    snaps = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "id long, committed_ms long")
    offs = spark.createDataFrame([(i, 0, 0 if i < 4 else 7, 50) for i in range(1, 7)], "id long, partition int, start long, end long")
    earliest = spark.createDataFrame([(0, 5)], "partition int, earliest long")
    none = earliest.limit(0)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(planning.expired_snapshots(snaps, offs, 60, 35, none)) == [1, 2]
    assert ids(planning.expired_snapshots(snaps, offs, 60, 1000, earliest)) == [1, 2, 3]
    assert ids(planning.expired_snapshots(snaps, offs, 10**6, 0, none)) == [1, 2, 3, 4, 5]
    files = spark.createDataFrame([(0, 0, 10), (0, 4, 10), (0, 10, 20), (0, 20, 30)], "partition int, start long, end long")
    assert planning.retained_starts(files, earliest).first().start == 10
    assert planning.retained_starts(files, spark.createDataFrame([(0, 25)], "partition int, earliest long")).first().start == 30


def test_overlaps_and_locations(spark):
    r = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 5, 8), (1, 0, 10, 12), (1, 1, 0, 3), (1, 1, 3, 9)], "topic_id int, partition int, start long, end long")
    assert [(x.start, x.end) for x in control.overlapping(r).collect()] == [(5, 8)]
    rows, cursor = control.page(r, ["partition", "start"], None, {"topic_id": 1}, 3)
    assert [x.start for x in rows] == [0, 5, 10] and cursor
    rows, cursor = control.page(r, ["partition", "start"], cursor, {"topic_id": 1}, 3)
    assert [x.start for x in rows] == [0, 3] and cursor is None
    with pytest.raises(ValueError):
        control.page(r, ["partition"], {"filters": {}, "after": [0]}, {"topic_id": 1}, 3)


def test_tiering_terms_and_options(spark, tmp_path):
    t = tiering.Term.parse("bucket(16, a.b) desc nulls last")
    assert (t.transform, t.width, t.column, t.descending, t.nulls_first) == ("bucket", 16, "a.b", True, False)
    assert tiering.Term.parse("x").nulls_first and not tiering.Term.parse("x desc").nulls_first
    with pytest.raises(ValueError):
        tiering.Term.parse("day(")
    with pytest.raises(ValueError):
        tiering.write_options("rar")
    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    tiering.write_history(df, str(tmp_path / "h"), ["bucket(4, g)"], ["id desc"], codec="gzip", bloom=("id",), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 100 and back.select("_part_g_bucket").distinct().count() <= 4
    with pytest.raises(ValueError):
        tiering.check_history(df.schema, df.schema, 1, 0, 0)
    tiering.check_history(df.schema, df.schema, 2, 0, 0)


def test_pruning_never_loses_a_match(spark):
    rng = random.Random(7)
    rows = [(f, rng.randrange(f * 5, f * 5 + 20)) for f in range(30) for _ in range(5)]
    df = spark.createDataFrame(rows, "f int, v int")
    files = df.groupBy("f").agg(F.min("v").alias("lower_v"), F.max("v").alias("upper_v"))
    for d in (pruning.Domain(((30, 40, True, False),)), pruning.Domain(values=(3, 77)), pruning.Domain(((None, 9, False, True), (140, None, False, False))), pruning.Domain()):
        hit = {r.f for r in df.where(d.column(F.col("v"))).collect()}
        kept = {r.f for r in pruning.pruned(files, {"v": d, "w": d}).collect()}
        assert hit <= kept
    assert len(pruning.pruned(files, {"v": pruning.Domain(values=(3,))}).collect()) < 30
    with pytest.raises(ValueError):
        pruning.resolve(["A", "a"], "a")
    packed = pruning.splits([(f"f{i}", (i % 7) << 23) for i in range(60)])
    assert sorted(x for s in packed for x in s) == sorted(f"f{i}" for i in range(60))
    assert all(sum(max(((int(x[1:]) % 7) << 23), 4 << 20) for x in s) <= 128 << 20 for s in packed)


def test_backfill():
    from tideframe.streaming.ingest import backfill_chunks

    assert list(backfill_chunks(25, 0, 10)) == [(15, 25), (5, 15), (0, 5)]


def test_value_rendering(spark):
    df = spark.createDataFrame([(b"ok", b"\xff\x00", 5, {"a": 1})], "b binary, x binary, n long, m map<string,int>")
    r = df.select(*[render.rendered(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(r) == ("ok", "/wA=", "5", '{"a":1}')


def test_snapshot_totals_by_intervals(spark):
    """Totals as counted by hand over every file and snapshot, with starts that turn, gaps and files of one key; no such pair is built."""
    rng = random.Random(11)
    snaps, offs, files = [], [], []
    for t in (1, 2):
        ids = sorted(rng.sample(range(1, 60), 25))
        snaps += [(t, i) for i in ids]
        for p in range(3):
            start, end = 40, 50
            for i in [*ids, 77]:  # no snapshot is 77
                start, end = max(0, start + rng.choice([0, 0, 0, 8, -8])), end + rng.choice([0, 6])
                if rng.random() < 0.9:
                    offs.append((t, i, p, start, end))
            for _ in range(120):
                a, n = rng.randrange(0, 120, 4), rng.choice([4, 8])
                added = rng.randrange(0, 60)
                files.append((t, p, a, a + n, rng.choice([1, 2]), rng.randrange(1, 9), added, added + rng.randrange(1, 30) if rng.random() < 0.6 else None))
    covering = {(t, i, p): (a, e) for t, i, p, a, e in offs}
    want, before = set(), {}
    for t, i in snaps:
        h = [f for f in files if f[0] == t and (t, i, f[1]) in covering and covering[t, i, f[1]][0] <= f[2] and f[3] <= covering[t, i, f[1]][1] and f[6] <= i < (f[7] or 99)]
        last, held = before.get(t, (None, set()))
        if h:
            want.add((t, i, last, len(h), sum(f[5] for f in h), sum(f[:5] not in held for f in h)))
        before[t] = (i, {f[:5] for f in h})
    got = control.snapshot_totals(
        spark.createDataFrame(snaps, "topic_id int, id int"), spark.createDataFrame(offs, "topic_id int, id int, partition int, start long, end long"),
        spark.createDataFrame(files, "topic_id int, partition int, start long, end long, bucket int, records long, added int, replaced long"),
    )
    assert got.columns == ["topic_id", "id", "previous", "files", "records", "new_files"]
    assert len(want) > 40 and {tuple(r) for r in got.collect()} == want


def test_snapshot_totals_pairs_no_files_with_snapshots(spark):
    n = 300
    files = spark.range(n).selectExpr("1 as topic_id", "0 as partition", "id * 10 as start", "id * 10 + 10 as end", "0 as bucket", "1L as records", "id + 1 as added", "cast(null as long) as replaced")
    snaps = spark.range(1, n + 1).selectExpr("1 as topic_id", "id")
    out = control.snapshot_totals(snaps, snaps.selectExpr("topic_id", "id", "0 as partition", "0L as start", "id * 10 as end"), files)
    plan = out._jdf.queryExecution()
    assert plan.toRdd().count() == n
    most, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in kind:
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 3 * n  # 45,150 pairs before
