"""Plans over file metadata: compaction runs, tiering, retention, expiry, garbage.

Metadata frames: files(partition, start, end, spec, bucket, schema, records, bytes, first_ts_ms, added,
replaced), snapshots(id, committed_ms), snapshot_offsets(id, partition, start, end). Running sums that
restart are folds over one partition's rows in order; everything else is joins and aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covers(start, end, inner_start, inner_end) -> Column:
    """Whether the half-open range holds the inner one."""
    return (start <= inner_start) & (inner_end <= end)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def files_of(files: DataFrame, offsets: DataFrame, snapshot: int) -> DataFrame:
    """The files that a snapshot reads: inside its offsets, added by then, not yet replaced then."""
    o = offsets.where(F.col("id") == snapshot).select(F.col("partition").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    live = files.where((F.coalesce("replaced", F.lit(1 << 62)) > snapshot) & (F.coalesce("added", F.lit(0)) <= snapshot))
    return live.join(o, (F.col("partition") == F.col("_p")) & covers(F.col("_s"), F.col("_e"), F.col("start"), F.col("end")), "left_semi")


def not_adjacent(files: DataFrame) -> DataFrame:
    """Ranges that do not begin where the one before ends (files of one range count once)."""
    ranges = files.select("partition", "start", "end").distinct()
    before = F.lag("end").over(Window.partitionBy("partition").orderBy("start", "end"))
    return ranges.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("start")))


def commit_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """operation, added and deleted files and records, and totals, between two sets of files."""
    key = ["partition", "start", "end", "spec", "bucket", "schema"]
    same = [before[k].eqNullSafe(after[k]) for k in key]
    added, deleted = after.join(before, same, "left_anti"), before.join(after, same, "left_anti")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"{n}_files"), F.coalesce(F.sum("records"), F.lit(0)).alias(f"{n}_records"))
    # three single rows side by side
    out = count(added, "added").withColumn("_k", F.lit(1)).join(count(deleted, "deleted").withColumn("_k", F.lit(1)), "_k")
    out = out.join(count(after, "total").withColumn("_k", F.lit(1)), "_k").drop("_k")
    operation = F.when(F.col("deleted_files") == 0, "append").when(F.col("added_files") == 0, "delete").otherwise("overwrite")
    return out.select(operation.alias("operation"), "*")


def manifests(files: DataFrame) -> DataFrame:
    """Files listed together, by spec, bucket and commit: spec, bucket, added, files, low, high."""
    return files.groupBy("spec", "bucket", "added").agg(F.count(F.lit(1)).alias("files"), F.min("start").alias("low"), F.max("end").alias("high"))


def assembly_runs(files: DataFrame, most_bytes: int, ended: Column) -> DataFrame:
    """Files to be put together: partition, spec, bucket, schema, run, start, end, files, records, bytes.

    Within a partition, time bucket and schema, files follow one another in a run up to most_bytes; other
    buckets' files may lie between them. A run needs two files. ended says whose buckets are over."""
    keys = ["partition", "spec", "bucket", "schema"]

    def fold(batches):
        at, run, size = None, -1, 0
        for pdf in batches:
            runs = []
            for row in pdf[[*keys, "start", "end", "bytes"]].itertuples(index=False):
                key = tuple(None if pd.isna(x) else x for x in row[:4])
                if key != at or size + row.bytes > most_bytes:
                    run, size = (0 if key != at else run + 1), 0
                    at = key
                size += row.bytes
                runs.append(run)
            yield pdf.assign(run=pd.Series(runs, dtype="int64", index=pdf.index))

    some = files.where(ended).select(*keys, "start", "end", "records", "bytes").repartition(*keys).sortWithinPartitions(*keys, "start")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
    found = some.mapInPandas(fold, kinds + ", run long")
    parts = F.array_sort(F.collect_list(F.struct("start", "end")))
    listed = F.concat_ws("", F.transform(parts, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"), F.lit("\n"))))
    out = found.groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"), F.substring(F.sha2(listed, 256), 1, 16).alias("hash"),
    )
    return out.where("files >= 2")


def expired_snapshots(snapshots: DataFrame, offsets: DataFrame, now_ms: int, retention_ms: int, earliest: DataFrame) -> DataFrame:
    """Ids up to the last that is older than the retention or covers deleted offsets; never the latest.

    earliest(partition, earliest): first offset that the log still has."""
    gone = offsets.join(earliest, "partition").where(F.col("start") < F.col("earliest")).select("id").distinct()
    latest = snapshots.agg(F.max("id")).first()[0]
    older = snapshots.where(F.col("id") < latest) if latest is not None else snapshots
    old = older.where(F.col("committed_ms") < now_ms - retention_ms).select("id").unionByName(gone.join(older.select("id"), "id"))
    bound = old.agg(F.max("id")).first()[0]
    return older.where(F.col("id") <= F.lit(bound)).select("id")


def retained_starts(files: DataFrame, earliest: DataFrame) -> DataFrame:
    """New start of each partition: the first file start at or behind earliest that lies inside no file,
    or the end of its files."""
    ranges = files.select("partition", "start", "end").distinct()
    before = F.max("end").over(Window.partitionBy("partition").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    clean = ranges.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") <= F.col("start")))
    found = clean.join(earliest, "partition").where(F.col("start") >= F.col("earliest")).groupBy("partition").agg(F.min("start").alias("_s"))
    ends = ranges.join(earliest.select("partition"), "partition", "left_semi").groupBy("partition").agg(F.max("end").alias("_e"))
    return ends.join(found, "partition", "left").select("partition", F.coalesce("_s", "_e").alias("start"))


def collectable(objects: DataFrame, referenced: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Objects(path, modified_ms) that nothing refers to and that are older than the grace."""
    return objects.where(F.col("modified_ms") < now_ms - grace_ms).join(referenced.select("path"), "path", "left_anti")


def tier_pieces(files: DataFrame, starts: DataFrame, cutoff_ms: int) -> DataFrame:
    """Pieces of each partition that may be tiered: partition, segment, start, end, bytes, first_ts_ms.

    From the partition's tier end (starts(partition, start)) on, up to the first file that is too new.
    A piece is what a file adds to the offsets before it (files of one range add nothing after the
    first). Segments are cut where no file spans the boundary; one that a newer file reaches into waits."""
    w = Window.partitionBy("partition").orderBy("start", "end", "first_ts_ms")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    f = files.join(starts.withColumnRenamed("start", "from"), "partition").where(F.col("start") >= F.col("from"))
    f = f.withColumn("_new", F.max((F.col("first_ts_ms") >= cutoff_ms).cast("int")).over(so_far))
    newest = f.where("_new = 1").groupBy("partition").agg(F.min("start").alias("_reach"))
    f = f.where("_new = 0")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_before", F.coalesce(before, F.col("from")))
    f = f.withColumn("segment", F.sum((F.col("_before") <= F.col("start")).cast("int")).over(so_far))
    tops = f.groupBy("partition", "segment").agg(F.max("end").alias("_top")).join(newest, "partition", "left").where("_reach is null or _reach >= _top")
    pieces = f.join(tops.select("partition", "segment"), ["partition", "segment"], "left_semi")
    adds = F.col("end") > F.col("_before")
    return pieces.select(
        "partition", "segment", F.greatest("start", "_before").alias("start"), F.greatest("end", "_before").alias("end"),
        F.when(adds, F.col("bytes")).otherwise(0).alias("bytes"), "first_ts_ms",
    )


def tier_segments(pieces: DataFrame) -> DataFrame:
    """partition, start, end, bytes, first_ts_ms of each segment of tier_pieces."""
    out = pieces.groupBy("partition", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("bytes").alias("bytes"), F.min("first_ts_ms").alias("first_ts_ms"))
    return out.drop("segment")


def _reads(pieces: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int]]:
    """Offset ranges in which (start, end, bytes) are read: at most limit bytes each, large pieces in even parts."""
    out: list[list[int]] = []
    for start, end, size in pieces:
        parts = max(1, min(-(-size // max(limit, 1)), end - start))
        step = -(-(end - start) // parts)
        for a in range(start, end, step):
            b, share = min(a + step, end), size // parts
            if out and out[-1][1] == a and out[-1][2] + share <= limit:
                out[-1][1], out[-1][2] = b, out[-1][2] + share
            else:
                out.append([a, b, share])
    return [(a, b) for a, b, _ in out]


def tier_flushes(pieces: DataFrame, overdue_ms: int, limit: int) -> DataFrame:
    """partition, flush, start, end, bytes, reads (offset ranges) of the tier's next writes.

    Segments gather until limit bytes; what is left is flushed only if some of it is overdue."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, size, oldest = [], [], 0, None

        def flush() -> None:
            own = [x for x in held if x[0] < x[1]]
            out.append((int(pdf["partition"].iloc[0]), len(out), own[0][0], own[-1][1], size, [{"start": a, "end": b} for a, b in _reads(own, limit)]))

        for _, segment in pdf.sort_values(["segment", "start", "end"]).groupby("segment"):
            held += [(int(r.start), int(r.end), int(r.bytes)) for r in segment.itertuples()]
            size += int(segment["bytes"].sum())
            first = int(segment["first_ts_ms"].min())
            oldest = first if oldest is None else min(oldest, first)
            if size >= limit:
                flush()
                held, size, oldest = [], 0, None
        if held and oldest < overdue_ms:
            flush()
        return pd.DataFrame(out, columns=["partition", "flush", "start", "end", "bytes", "reads"])

    return pieces.groupBy("partition").applyInPandas(fold, "partition int, flush long, start long, end long, bytes long, reads array<struct<start:long,end:long>>")


def tier_lag(files: DataFrame, ends: DataFrame) -> DataFrame:
    """First time of what is not tiered yet, by partition."""
    return files.join(ends, "partition").where(F.col("start") >= F.col("tier_end")).groupBy("partition").agg(F.min("first_ts_ms").alias("oldest_untiered_ms"))


def contiguous(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """The ranges(partition, start, end) of each partition behind its tier end that follow one another without a gap."""
    w = Window.partitionBy("partition").orderBy("start")
    r = ranges.join(ends, "partition").where(F.col("start") >= F.col("tier_end"))
    before = F.lag("end").over(w)
    r = r.withColumn("_gap", (before.isNotNull() & (F.col("start") != before)).cast("int"))
    return r.withColumn("_gaps", F.sum("_gap").over(w)).where(F.col("_gaps") == 0).drop("_gap", "_gaps", "tier_end")
