"""Cutting a partition's records into files: by size, time span and bucket, and by bucket within a range."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.functions.buckets import floor_div

FILE_BYTES, FILE_WINDOW_MS = 128 << 20, 60_000


class Grouper:
    """The open group of a partition; feed records in offset order."""

    def __init__(self, file_bytes: int, window_ms: int, state: tuple | None = None) -> None:
        self.file_bytes, self.window_ms = file_bytes, window_ms
        self.number, self.size, self.first, self.top = state or (0, 0, None, None)

    def state(self) -> tuple:
        return self.number, self.size, self.first, self.top

    def add(self, ts_ms: int, size: int, bucket: int | None) -> int:
        """The record's group number.

        A bucket above all of the group's starts a group before the record; reaching the size or the
        time span ends the group after it."""
        if self.first is not None and bucket is not None and self.top is not None and bucket > self.top:
            self._close()
        if self.first is None:
            self.first, self.size, self.top = ts_ms, 0, bucket
        self.size += size
        if bucket is not None and (self.top is None or bucket > self.top):
            self.top = bucket
        number = self.number
        if self.size >= self.file_bytes or ts_ms - self.first >= self.window_ms:
            self._close()
        return number

    def add_all(self, ts_ms: np.ndarray, size: np.ndarray, bucket: pd.Series) -> list[int]:
        """Positions of the records that begin a group, as add finds them one by one."""
        found, null = [], bucket.isna().to_numpy()
        if null.any() and not null.all() or self.first is not None and self.top is None and not null.all():
            for i, b in enumerate(bucket):
                held = self.number if self.first is not None else None
                if self.add(int(ts_ms[i]), int(size[i]), None if null[i] else int(b)) != held:
                    found.append(i)
            return found
        buckets = None if null.all() else bucket.to_numpy(dtype="int64")
        i, step = 0, 64
        while i < len(ts_ms):
            if self.first is None:
                self.first, self.size, self.top = int(ts_ms[i]), 0, None if buckets is None else int(buckets[i])
                found.append(i)
            some = slice(i, i + step)
            total = self.size + np.cumsum(size[some])
            above = np.zeros(len(total), bool) if buckets is None or self.top is None else buckets[some] > self.top
            over = above | (total >= self.file_bytes) | (ts_ms[some] - self.first >= self.window_ms)
            k = int(over.argmax())
            if not over[k]:
                self.size, i, step = int(total[-1]), i + len(total), 2 * step
                continue
            i, step = i + (k if above[k] else k + 1), 64
            self._close()
        return found

    def _close(self) -> None:
        self.number, self.size, self.first, self.top = self.number + 1, 0, None, None


def file_ranges(records: DataFrame, file_bytes: int = FILE_BYTES, window_ms: int = FILE_WINDOW_MS) -> list[tuple[int, int, int, int, bool]]:
    """partition, group, start, end and last of each group of records(partition, offset, ts_ms, size, bucket): offsets from
    its first record to the next group's first (gaps belong to the group before); last marks a partition's trailing group.

    Of stretches whose size and time span cannot end a group nothing more is read; the others are folded. The driver
    holds one row for each bucket of a partition and one for each group."""
    some = records.select("partition", "offset", "ts_ms", "size", "bucket")
    stretches = _stretches(some, file_bytes, window_ms)
    starts: dict[int, set] = {}
    for p, start, _, whole in stretches:
        starts.setdefault(p, set()).update({start} if whole else ())
    todo = [(p, s, e) for p, s, e, whole in stretches if not whole]
    if todo:
        for r in _folded(some, todo, file_bytes, window_ms, False).collect():
            starts[r.partition].add(r.offset)
    ends = {p: e for p, _, e, _ in stretches}  # the last stretch's stays
    out = []
    for p, own in starts.items():
        begun = sorted(own)
        out += [(p, g, s, e, g == len(begun) - 1) for g, (s, e) in enumerate(zip(begun, [*begun[1:], ends[p]]))]
    return out


def file_groups(records: DataFrame, file_bytes: int = FILE_BYTES, window_ms: int = FILE_WINDOW_MS) -> DataFrame:
    """records(partition, offset, ts_ms, size, bucket) with their group number."""
    some = records.select("partition", "offset", "ts_ms", "size", "bucket")
    stretches = [(p, s, e) for p, s, e, _ in _stretches(some, file_bytes, window_ms)]
    grouped = _folded(some, stretches, file_bytes, window_ms, True)
    earlier = Window.partitionBy("partition").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = grouped.groupBy("partition", "stretch").agg((F.max("group") + 1).alias("_n"))
    counts = counts.select("partition", "stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = grouped.join(counts, ["partition", "stretch"]).withColumn("group", F.col("group") + F.col("_before"))
    return found.select("partition", "offset", "ts_ms", "size", "bucket", "group")


def _folded(some: DataFrame, stretches: list[tuple], file_bytes: int, window_ms: int, every: bool) -> DataFrame:
    """The records with stretch and number of their group in it, or only those that begin a group.

    Each stretch is read in offset order in one task; only the open group is held."""

    def fold(batches):
        group, at, number = None, None, -1
        for pdf in batches:
            p, stretch, ts, size = (pdf[c].to_numpy() for c in ("partition", "stretch", "ts_ms", "size"))
            first, numbers = np.zeros(len(p), bool), np.zeros(len(p), "int64")
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(p)]) if len(p) else ():
                if (p[i], stretch[i]) != at:
                    group, at, number = Grouper(file_bytes, window_ms), (p[i], stretch[i]), -1
                first[i:j][group.add_all(ts[i:j], size[i:j], pdf["bucket"][i:j])] = True
                numbers[i:j] = number + np.cumsum(first[i:j])
                number = numbers[j - 1]
            out = pdf.assign(group=numbers)
            yield out if every else out[first]

    rows = in_ranges(some, [(p, s, e, s) for p, s, e in stretches], "stretch long").select("partition", "stretch", "offset", "ts_ms", "size", "bucket")
    rows = rows.repartition("partition", "stretch").sortWithinPartitions("partition", "stretch", "offset")
    return rows.mapInPandas(fold, "partition int, stretch long, offset long, ts_ms long, size long, bucket int, group long")


def _stretches(some: DataFrame, file_bytes: int, window_ms: int) -> list[tuple[int, int, int, bool]]:
    """partition, start and end of stretches that are grouped by themselves, and whether each is surely one group.

    A record whose bucket is above all earlier ones of its partition begins a group whatever came before."""
    measured = some.groupBy("partition", "bucket").agg(
        F.min("offset").alias("low"), F.max("offset").alias("high"), F.sum("size").alias("size"), F.max("ts_ms").alias("late"), F.min_by("ts_ms", "offset").alias("at")
    )
    seen: dict[int, list] = {}
    for r in measured.collect():  # one row for each bucket of a partition
        seen.setdefault(r.partition, []).append(r)
    out = []
    for p, found in sorted(seen.items()):
        begun, whole = _beginnings(sorted(found, key=lambda r: r.low), file_bytes, window_ms)
        out += [(p, s, e, w) for s, e, w in zip(begun, [*begun[1:], max(r.high for r in found) + 1], whole)]
    return out


def _beginnings(found: list, file_bytes: int, window_ms: int) -> tuple[list[int], list[bool]]:
    """First offsets of one partition's stretches, and whether each is surely one group.

    found, by low: low and high offset, size, latest time (late) and time of the first record (at) of each bucket."""
    if any(r.bucket is None for r in found):  # such a record ends no group
        r = found[0]
        return [r.low], [len(found) == 1 and r.size < file_bytes and r.late - r.at < window_ms]
    begun = []
    for r in found:
        if not begun or r.bucket > begun[-1].bucket:
            begun.append(r)
    lows = [r.low for r in begun]
    added, late = [0] * (len(lows) + 1), [r.late for r in begun]
    for r in found:  # a bucket's size counts in each stretch that it may have records in
        k = bisect_right(lows, r.low) - 1
        added[k] += r.size
        added[bisect_right(lows, r.high)] -= r.size
        late[k] = max(late[k], r.late)
    whole, size, latest = [], 0, late[0]
    for k, r in enumerate(begun):
        size, latest = size + added[k], max(latest, late[k])
        whole.append(size < file_bytes and latest - r.at < window_ms)
    return lows, whole


def in_ranges(records: DataFrame, ranges: list[tuple], more: str = "") -> DataFrame:
    """records(partition, offset, ...) that lie in a range, with the range's columns beside partition, start and end.

    ranges are (partition, start, end, ...) without overlaps; more names and types the rest. Ranges are broadcast under
    cells of offsets as wide as a range on average, so a record meets few of them."""
    width = max(1, sum(e - s for _, s, e, *_ in ranges) // max(1, len(ranges)))
    cells = [(r[0], c, *r[1:]) for r in ranges for c in range(r[1] // width, (r[2] - 1) // width + 1)]
    names = ["start", "end", *(x.split()[0] for x in more.split(",") if x)]
    known = records.sparkSession.createDataFrame(cells, "partition int, _cell long, start long, end long" + (f", {more}" if more else ""))
    known = known.withColumnsRenamed({n: f"_in_{n}" for n in names})
    met = records.withColumn("_cell", floor_div(F.col("offset"), width)).join(F.broadcast(known), ["partition", "_cell"])
    met = met.where("offset >= _in_start and offset < _in_end").drop("_cell")
    return met.withColumnsRenamed({f"_in_{n}": n for n in names})


def group_ranges(grouped: DataFrame) -> DataFrame:
    """One row for each group: offsets from its first record to the next group's first (gaps belong to the
    group before), records, bytes, first time, and last, which marks the partition's trailing group."""
    out = grouped.groupBy("partition", "group").agg(
        F.min("offset").alias("start"), F.max("offset").alias("last_offset"), F.count(F.lit(1)).alias("records"),
        F.sum("size").alias("bytes"), F.min("ts_ms").alias("first_ts_ms"), F.max("bucket").alias("top_bucket"),
    )
    w = Window.partitionBy("partition").orderBy("group")
    following = F.lead("start").over(w)
    return out.select(
        "partition", "group", "start", F.coalesce(following, F.col("last_offset") + 1).alias("end"), "records", "bytes", "first_ts_ms", following.isNull().alias("last")
    )


def bucket_files(records: DataFrame) -> DataFrame:
    """records(partition, start, end, bucket, ts_ms, size): one file for each bucket of a range; each
    carries the whole range of offsets."""
    return records.groupBy("partition", "start", "end", "bucket").agg(
        F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"), F.min("ts_ms").alias("first_ts_ms")
    )
