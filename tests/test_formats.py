"""Wire batches, single values, SQL text."""

import datetime as dt
import decimal
import struct
import zlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import types as T

from tideframe.functions import sqltext
from tideframe.operators import encoding, paths
from tideframe.sources import batches


def varint(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def sized(b):
    return varint(-1) if b is None else varint(len(b)) + b


def batch(base, rows, codec=0, flags=0, first=1000, most=5000):
    body = b""
    for i, (key, value, headers) in enumerate(rows):
        r = b"\0" + varint(i * 10) + varint(i) + sized(key) + sized(value) + varint(len(headers)) + b"".join(sized(k) + sized(v) for k, v in headers)
        body += varint(len(r)) + r
    if codec == 1:
        c = zlib.compressobj(wbits=31)
        body = c.compress(body) + c.flush()
    elif codec == 2:
        block = pa.Codec("snappy").compress(body).to_pybytes()
        body = b"\x82SNAPPY\0" + struct.pack(">ii", 1, 1) + struct.pack(">i", len(block)) + block
    elif codec == 3:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(body)
        body = sink.getvalue().to_pybytes()
    elif codec == 4:
        body = zstandard.compress(body)
    tail = struct.pack(">hiqqqhii", codec | flags, len(rows) - 1, first, most, 7, 0, 0, len(rows)) + body
    return struct.pack(">qiib", base, 4 + 1 + 4 + len(tail), 0, 2) + struct.pack(">I", batches.crc32c(tail)) + tail


def test_batches(spark):
    assert batches.crc32c(b"123456789") == 0xE3069283
    rows = [(b"k", b"v", [(b"h", None)]), (None, None, [])]
    for codec in range(5):
        got = list(batches.records(3, batch(40, rows, codec)))
        assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(3, 40, 1000, b"k", b"v"), (3, 41, 1010, None, None)]
    whole = batch(0, rows) + batch(2, rows, flags=8) + batch(4, [(struct.pack(">hh", 0, 0), b"", [])], flags=48)
    got = list(batches.records(0, whole + batch(9, rows)[:-3]))
    assert [r[1] for r in got] == [0, 1, 2, 3, 4] and got[2][2] == got[3][2] == 5000 and got[4][-1] == "abort" and got[4][-2]
    broken = bytearray(batch(0, rows))
    broken[-1] ^= 1
    with pytest.raises(batches.Corrupt):
        list(batches.records(0, bytes(broken)))
    df = spark.createDataFrame([(0, whole), (1, None)], "partition int, data binary")
    assert batches.unpacked(df).count() == 5


def test_single_values():
    e = encoding.encoded
    assert e(5, T.IntegerType()) == b"\x05\0\0\0" and e(-1, T.LongType()) == b"\xff" * 8 and e("é", T.StringType()) == "é".encode()
    assert e(decimal.Decimal("-1.28"), T.DecimalType(9, 2)) == b"\x80" and e(decimal.Decimal("1.28"), T.DecimalType(9, 2)) == b"\x00\x80"
    assert e(dt.date(1970, 1, 2), T.DateType()) == b"\x01\0\0\0" and e(dt.datetime(1970, 1, 1, 0, 0, 1), T.TimestampNTZType()) == struct.pack("<q", 10**6)
    assert e(None, T.LongType()) is None and len(e("12345678-1234-5678-1234-567812345678", T.StringType(), "uuid")) == 16
    kind = T.StructType([T.StructField("a", T.ArrayType(T.LongType())), T.StructField("u", T.StringType(), True, {"logical": "uuid"})])
    assert encoding.connector_type(kind) == "struct<a: list<bigint>, u: varchar>"
    t = "12345678-1234-5678-1234-567812345678"
    assert paths.view_id(t, "lake") == paths.view_id(t, "lake") != paths.view_id(t, "stream")


def test_sql_text(spark):
    assert sqltext.identifier("a`b") == "`a``b`" and sqltext.literal("it's") == r"'it\'s'" and sqltext.literal(None) == "null"
    assert spark.sql(f"select {sqltext.literal('it' + chr(39) + 's')} as x").first().x == "it's"
    assert sqltext.tables(spark, "with c as (select * from lake.t1) select * from c join t2 using (id) where x in (select 1)") == ["lake.t1", "t2"]
    try:
        spark.sql("select * from nowhere_at_all").collect()
    except Exception as e:
        text = sqltext.error_text(e)
        assert "nowhere_at_all" in text and "SQLSTATE" not in text and not text.startswith("[")
    assert sqltext.same_rows([(1.0, "a")], [(1.0 + 1e-12, "a")]) and not sqltext.same_rows([(1.0,)], [(1.1,)])
