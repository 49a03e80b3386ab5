"""Live indexing as a structured stream, and backfill in bounded chunks.

The stream keeps nothing back for late records: a late record goes to a file of its own old bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BACKFILL_OFFSETS = 100_000


def follow(spark: SparkSession, schema, path: str, checkpoint: str, index: Callable[[DataFrame, int], None], poll_ms: int | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Index what arrives in a directory of log files.

    index(records, batch) must give the same result when a batch is repeated (it is, after a failure).
    Without poll_ms everything there is is indexed and the stream ends."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    writer = source.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{poll_ms} milliseconds") if poll_ms else writer.trigger(availableNow=True)).start()


def backfill_chunks(start: int, target: int, size: int = BACKFILL_OFFSETS) -> Iterator[tuple[int, int]]:
    """Offset ranges below start down to target, newest first."""
    end = start
    while end > target:
        begin = max(target, end - size)
        yield begin, end
        end = begin


def backfill(records: DataFrame, partition: int, start: int, target: int, write: Callable[[DataFrame, int, int], None], size: int = BACKFILL_OFFSETS) -> list[tuple[int, int]]:
    """Write a partition's older records chunk by chunk; a chunk without records joins the one below it."""
    done, end = [], start
    for begin, _ in backfill_chunks(start, target, size):
        part = records.where((F.col("partition") == partition) & (F.col("offset") >= begin) & (F.col("offset") < end))
        if begin > target and not part.limit(1).count():
            continue
        write(part, begin, end)
        done.append((begin, end))
        end = begin
    return done
