"""Schema references in front of payloads, as column expressions over bytes and headers."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_INFLATED = 64 << 20


def header_name(part: str) -> str:
    return f"__{part}_schema_id"



def wire_header(payload: Column, headers: Column, part: str = "value") -> Column:
    """struct(kind, id, compressed, body) of a payload.

    In this order: ``guid`` from the last header of the part (byte 1, 16 bytes; what follows there is
    put before the payload), ``uuid`` from byte 3, a compression byte (0 or 5) and 16 bytes, ``id``
    from byte 0 and a big-endian number of 32 bits. Anything else has kind null and is kept whole."""
    guid = F.try_element_at(F.filter(headers, lambda h: h["key"] == F.lit(header_name(part))), F.lit(-1))["value"]
    by_header = (F.octet_length(guid) >= 17) & (F.hex(F.substring(guid, 1, 1)) == "01")
    lead = F.hex(F.substring(payload, 1, 1))
    packing = F.hex(F.substring(payload, 2, 1))
    by_uuid = (lead == "03") & packing.isin("00", "05") & (F.octet_length(payload) >= 18)
    by_id = (lead == "00") & (F.octet_length(payload) >= 5)
    rest = lambda c, at: F.substring(c, at, 1 << 30)
    number = F.conv(F.hex(F.substring(payload, 2, 4)), 16, 10)
    none = F.lit(None).cast("string")
    found = F.struct
    return (
        F.when(
            by_header,
            found(F.lit("guid").alias("kind"), F.lower(F.hex(F.substring(guid, 2, 16))).alias("id"), F.lit(False).alias("compressed"),
                  F.concat(rest(guid, 18), F.coalesce(payload, F.lit(b""))).alias("body")),
        )
        .when(
            by_uuid,
            found(F.lit("uuid").alias("kind"), F.lower(F.hex(F.substring(payload, 3, 16))).alias("id"), (packing == "05").alias("compressed"),
                  rest(payload, 19).alias("body")),
        )
        .when(by_id, found(F.lit("id").alias("kind"), number.alias("id"), F.lit(False).alias("compressed"), rest(payload, 6).alias("body")))
        .otherwise(found(none.alias("kind"), none.alias("id"), F.lit(False).alias("compressed"), payload.alias("body")))
    )


@F.pandas_udf(T.BinaryType())
def inflate(body: pd.Series) -> pd.Series:
    """zlib bodies unpacked; null where they are broken or unpack to more than 64 MiB."""

    def one(b):
        if b is None:
            return None
        d = zlib.decompressobj()
        try:
            out = d.decompress(b, MOST_INFLATED)
        except zlib.error:
            return None
        return out if d.eof and not d.unconsumed_tail else None

    return body.map(one)
