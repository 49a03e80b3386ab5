"""Shared pieces of the training-data operators: table access, shared folders, byte-level numpy helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.session import ship

#: Bytes that end a word everywhere in this subpackage: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Texts are worked on in groups of this many bytes at most, so that numpy temporaries stay small; a longer
#: text is a group of its own. One below a power of two: tables of powers are that long.
GROUP_BYTES = (1 << 20) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where no such folder is named (tests on one machine) one below the warehouse is used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def by_bytes(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df with function applied to each Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return this process's freed memory to the system; a no-op where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """function for mapInArrow that starts without what the worker's last task freed, and leaves nothing itself:
    workers outlive their tasks, and beside a full heap of the executor what they hold for nothing counts."""

    def run(batches):
        give_back()
        yield from function(batches)
        give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the polynomial hash's base modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, _BASE, np.uint64)
            step[0] = 1
            back = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] = hash of data[:j]; range_hash derives the hash of any range from it."""
    up, _ = POWERS.upto(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    _, down = POWERS.upto(len(h))
    return mix64((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of the texts that stand in data at bounds[i]:bounds[i+1]."""
    inside = ~_IS_SPACE[data]
    change = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a word that runs over a boundary between texts is two words
    cuts = bounds[1:-1]
    k = np.searchsorted(starts, cuts, "left") - 1
    ok = (k >= 0) & (cuts > 0) & (cuts < len(data))
    k, cuts = k[ok], cuts[ok]
    over = (starts[k] < cuts) & (ends[k] > cuts)
    if over.any():
        c = np.unique(cuts[over])
        starts, ends = np.sort(np.concatenate((starts, c))), np.sort(np.concatenate((ends, c)))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the bounds of the texts in it."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds
