"""Relational queries over the engine's metadata: totals, pages, owners, leases, listings.

Frames: topics(name, topic_id, state, partitions), files(topic_id, partition, start, end, bucket, records, bytes,
first_ts_ms, added, replaced), snapshots(topic_id, id, committed_ms), snapshot_offsets(topic_id, id,
partition, start, end), ranges(topic_id, partition, start, end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.operators.planning import covers, overlaps


def live_files(files: DataFrame, partition: int, start: int, end: int) -> DataFrame:
    """Unreplaced files of a partition inside a range, in order."""
    inside = (F.col("partition") == partition) & covers(F.lit(start), F.lit(end), F.col("start"), F.col("end"))
    return files.where(inside & F.col("replaced").isNull()).orderBy("start", "bucket")


def snapshot_totals(snapshots: DataFrame, offsets: DataFrame, files: DataFrame) -> DataFrame:
    """id, previous id, files, records, and how many files the snapshot added over the one before.

    Each file is held by one interval of snapshots in each run of _runs, so files and snapshots are not paired:
    an interval adds at its first snapshot and takes away behind its last one."""
    by_id = Window.partitionBy("topic_id").orderBy("id")
    s = snapshots.select("topic_id", "id", F.lag("id").over(by_id).alias("previous"), F.row_number().over(by_id).alias("k"))
    key = ["topic_id", "partition", "start", "end", "bucket"]
    life = ["topic_id", "partition", "start", "end", "added", "replaced"]
    f = files.withColumn("replaced", F.coalesce("replaced", F.lit(1 << 62)))
    spans = _held(f.select(*life).distinct(), _runs(offsets, s))
    held = f.join(spans, life).select(*key, "records", "low", "high")
    # new is what no file of its key was held for in the snapshot before
    earlier = Window.partitionBy(*key).orderBy("low").rangeBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("new", (F.coalesce(F.max("high").over(earlier), F.lit(-1)) < F.col("low") - 1).cast("long"))
    one = F.lit(1).cast("long")
    steps = held.select("topic_id", F.explode(F.array(
        F.struct(F.col("low").alias("k"), one.alias("files"), F.col("records").alias("records"), F.col("new").alias("new")),
        F.struct((F.col("high") + 1).alias("k"), (-one).alias("files"), (-F.col("records")).alias("records"), F.lit(0).cast("long").alias("new")),
    )).alias("s")).groupBy("topic_id", "s.k").agg(*[F.sum(f"s.{c}").alias(c) for c in ("files", "records", "new")])
    so_far = Window.partitionBy("topic_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = s.join(steps, ["topic_id", "k"], "left").select(
        "topic_id", "id", "previous", F.sum("files").over(so_far).alias("files"), F.sum("records").over(so_far).alias("records"), F.coalesce("new", F.lit(0)).alias("new_files")
    )
    return totals.where("files > 0")


def _runs(offsets: DataFrame, s: DataFrame) -> DataFrame:
    """offsets with the snapshot's place (k) and the number of its run: successive snapshots of a partition
    whose ends do not fall and whose starts do not turn; up says whether the run's starts rise."""
    o = offsets.join(s.select("topic_id", "id", "k"), ["topic_id", "id"])
    w = Window.partitionBy("topic_id", "partition").orderBy("k")
    moved = F.signum(F.col("start") - F.lag("start").over(w))
    o = o.withColumn("_way", F.when(moved != 0, moved))
    way = F.last("_way", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = (F.col("end") < F.lag("end").over(w)) | (F.col("k") != F.lag("k").over(w) + 1) | (F.col("_way") != way)
    o = o.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("run", F.sum("_cut").over(w))
    # the first snapshot of a run may have moved the other way: only moves inside the run count
    inside = F.max(F.when(F.col("_cut") == 0, F.col("_way"))).over(Window.partitionBy("topic_id", "partition", "run"))
    return o.select("topic_id", "partition", "run", "id", "k", "start", "end", (F.coalesce(inside, F.lit(1.0)) > 0).alias("up"))


def _held(life: DataFrame, o: DataFrame) -> DataFrame:
    """life(topic_id, partition, start, end, added, replaced) with low and high of each interval of snapshots (k) that holds it.

    Bounds are looked up by one pass over a run's snapshots and the files' bounds, in the order of each."""
    run = ["topic_id", "partition", "run"]
    runs = o.groupBy(*run).agg(F.min("k").alias("_first"), F.max("k").alias("_last"), F.any_value("up").alias("up"))
    none = F.lit(None)
    points = o.select(*run, "start", "end", F.col("id").alias("added"), F.col("id").alias("replaced"), "k", none.cast("int").alias("_first"), none.cast("int").alias("_last"), "up")
    both = life.join(runs, ["topic_id", "partition"]).withColumn("k", none.cast("int")).select(*points.columns).unionByName(points)
    over = lambda c, to: Window.partitionBy(*run).orderBy(c).rangeBetween(Window.unboundedPreceding, to)
    both = both.withColumns({
        "_from_end": F.min("k").over(over(F.desc("end"), Window.currentRow)), "_from_added": F.min("k").over(over(F.desc("added"), Window.currentRow)),
        "_to_replaced": F.max("k").over(over(F.col("replaced"), -1)), "_from_start": F.min("k").over(over(F.col("start"), Window.currentRow)),
        "_to_start": F.max("k").over(over(F.col("start"), Window.currentRow)),
    })
    found = both.where("_first is not null and _from_end is not null and _from_added is not null and _to_replaced is not null and _from_start is not null")
    low = F.greatest("_from_end", "_from_added", "_first", F.when(~F.col("up"), F.col("_from_start")))
    high = F.least("_to_replaced", "_last", F.when(F.col("up"), F.col("_to_start")))
    found = found.withColumns({"low": low, "high": high}).where("low <= high")
    return found.select("topic_id", "partition", "start", "end", "added", "replaced", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def trimmed_files(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files that no longer lie inside their partition's indexed range (the widest for each start)."""
    r = ranges.groupBy("topic_id", "partition", "start").agg(F.max("end").alias("end"))
    r = r.select(F.col("topic_id").alias("_t"), F.col("partition").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = (files.topic_id == r["_t"]) & (files.partition == r["_p"]) & covers(r["_s"], r["_e"], files.start, files.end)
    return files.join(r, held, "left_anti")


def replaced_files(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files replaced at or before the oldest snapshot that is left: nothing reads them any more."""
    oldest = snapshots.groupBy("topic_id").agg(F.min("id").alias("oldest"))
    return files.join(oldest, "topic_id").where(F.col("replaced") <= F.col("oldest")).drop("oldest")


def table_summaries(topics: DataFrame, snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Each topic with its latest snapshot and the sums of its files (0 without any)."""
    latest = snapshots.groupBy("topic_id").agg(F.max_by(F.struct("id", "committed_ms"), "id").alias("latest"))
    sums = files.where(F.col("replaced").isNull()).groupBy("topic_id").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    out = topics.join(latest, "topic_id", "left").join(sums, "topic_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("name", "state", F.col("latest.id").alias("snapshot"), F.col("latest.committed_ms").alias("committed_ms"), zero("records"), zero("bytes"), zero("files"))


def totals(topics: DataFrame, files: DataFrame) -> DataFrame:
    """One row: topics, listed topics, files, records, bytes."""
    t = topics.agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.col("state") == "indexing").alias("listed")).withColumn("_k", F.lit(1))
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("_k", F.lit(1))
    return t.join(f, "_k").drop("_k")


def listing(topics: DataFrame, prefix: str = "", after: str | None = None, limit: int = 100) -> DataFrame:
    """Names that start with a prefix and come after a name."""
    some = topics.where(F.col("name").startswith(prefix))
    return (some.where(F.col("name") > after) if after is not None else some).orderBy("name").limit(limit)


#: Sort key of the files page; null buckets come before all others.
_FILE_KEY = ("topic_id", "partition", "start", "end", "bucket")


def _key(columns: tuple[str, ...]) -> Column:
    return F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 62))).alias(c) for c in columns])


def files_page(files: DataFrame, after: tuple | None = None, partition: int | None = None, limit: int = 100) -> DataFrame:
    """Files after a key, compared as one row value."""
    out = files if partition is None else files.where(F.col("partition") == partition)
    if after is not None:
        bound = F.struct(*[F.lit(-(1 << 62) if x is None else x).cast("long").alias(c) for c, x in zip(_FILE_KEY, after)])
        out = out.where(_key(_FILE_KEY) > bound)
    return out.orderBy(_key(_FILE_KEY)).limit(limit)


def snapshots_page(snapshots: DataFrame, offsets: DataFrame, before: int | None = None, limit: int = 10) -> DataFrame:
    """Newest snapshots first, with the sum of their offsets' lengths."""
    page = (snapshots.where(F.col("id") < before) if before is not None else snapshots).orderBy(F.desc("id")).limit(limit)
    sums = offsets.groupBy("topic_id", "id").agg(F.sum(F.col("end") - F.col("start")).alias("span"))
    return page.join(sums, ["topic_id", "id"], "left").orderBy(F.desc("id"))


def registry_page(schemas: DataFrame, uses: DataFrame) -> DataFrame:
    """Each schema with the topics that use it, in order; none gives an empty list."""
    used = schemas.join(uses, "schema_id", "left").groupBy("schema_id", "kind")
    return used.agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def schema_tables(uses: DataFrame, schema_id: int) -> DataFrame:
    return uses.where(F.col("schema_id") == schema_id).select("topic").distinct()


def listed_topics(topics: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Indexed topics that have a snapshot."""
    return topics.where(F.col("state") == "indexing").join(snapshots.select("topic_id").distinct(), "topic_id", "left_semi").select("name")


def leases_page(leases: DataFrame, after: tuple[str, str | None] | None = None, limit: int = 100) -> DataFrame:
    """Leases after (resource, owner); no owner sorts first."""
    key = F.struct(F.col("resource"), F.coalesce("owner", F.lit("")).alias("owner"))
    out = leases.withColumn("owner", F.coalesce("owner", F.lit("")))
    if after is not None:
        out = leases.where(key > F.struct(F.lit(after[0]).alias("resource"), F.lit(after[1] or "").alias("owner"))).withColumn("owner", F.coalesce("owner", F.lit("")))
    return out.orderBy("resource", "owner").limit(limit)


def claim(leases: DataFrame, node: str, wanted: list[str] | None, now_ms: int, length_ms: int) -> DataFrame:
    """Leases after a node's claim (to all, if it names none): its own are renewed; free and run-out ones
    change hands with a new epoch."""
    own, free = F.col("owner").eqNullSafe(F.lit(node)), F.col("owner").isNull() | (F.col("until_ms") <= now_ms)
    takes = own | free if wanted is None else F.col("resource").isin(wanted) & (own | free)
    return leases.select(
        "resource",
        F.when(takes, F.lit(node)).otherwise(F.col("owner")).alias("owner"),
        F.when(takes & ~own, F.col("epoch") + 1).otherwise(F.col("epoch")).alias("epoch"),
        F.when(takes, F.lit(now_ms + length_ms)).otherwise(F.col("until_ms")).alias("until_ms"),
    )


def fenced(leases: DataFrame, resource: str, node: str | None, epoch: int) -> DataFrame:
    """The lease, if that node holds it in that epoch."""
    return leases.where((F.col("resource") == resource) & F.col("owner").eqNullSafe(F.lit(node)) & (F.col("epoch") == epoch))


def overlapping(ranges: DataFrame) -> DataFrame:
    """Pairs of one partition's ranges that overlap: only neighbours by start need a look, with the greatest end so far."""
    w = Window.partitionBy("topic_id", "partition").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("reach", F.max("end").over(w))
    return out.where(overlaps(F.col("start"), F.col("end"), F.lit(-1), F.col("reach")))


def owner_of(locations: DataFrame, path: str) -> DataFrame:
    """The deepest of the locations that hold a path."""
    parts = path.split("/")
    above = ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]
    return locations.where(F.col("location").isin(above)).orderBy(F.desc(F.length("location"))).limit(1)


def conflicting(locations: DataFrame, location: str, table: str | None) -> DataFrame:
    """Locations of other tables that hold a location, equal it, or lie in it."""
    parts = location.split("/")
    above = ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]
    near = F.col("location").isin(above) | F.col("location").startswith(location + "/")
    return locations.where(near & ~F.col("table").eqNullSafe(F.lit(table)))


def settled(ranges: DataFrame, ends: DataFrame) -> DataFrame:
    """Ranges up to their partition's end, of partitions in which one of them ends exactly there."""
    r = ranges.join(ends.select("partition", F.col("end").alias("upto")), "partition").where(F.col("end") <= F.col("upto"))
    exact = r.groupBy("partition").agg(F.max("end").alias("_m"), F.max("upto").alias("_u")).where("_m = _u").select("partition")
    return r.join(exact, "partition", "left_semi").drop("upto")


def tier_ends(written: DataFrame, settled_ranges: DataFrame) -> DataFrame:
    """partition, tier_end over written and settled ranges."""
    both = written.select("partition", "end").unionByName(settled_ranges.select("partition", "end"))
    return both.groupBy("partition").agg(F.max("end").alias("tier_end"))


def crossing_end(written: DataFrame, settled_ranges: DataFrame, partition: int, start: int, end: int) -> DataFrame:
    """A tier end strictly inside an offset range, if there is one."""
    both = written.select("partition", "end").unionByName(settled_ranges.select("partition", "end"))
    return both.where((F.col("partition") == partition) & (F.col("end") > start) & (F.col("end") < end)).orderBy("end").limit(1)


def earliest_live(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """First time of the files that lie in an indexed range, by topic."""
    r = ranges.select("topic_id", "partition", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = files.join(r, ["topic_id", "partition"]).where(covers(F.col("_s"), F.col("_e"), F.col("start"), F.col("end")))
    return held.groupBy("topic_id").agg(F.min("first_ts_ms").alias("earliest_ms"))


def removable(topics: DataFrame, snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Topics being removed that have no snapshot younger than an hour."""
    young = snapshots.where(F.col("committed_ms") > now_ms - 3_600_000).select("topic_id").distinct()
    return topics.where(F.col("state") == "removing").join(young, "topic_id", "left_anti").select("name")


def page(df: DataFrame, order: list[str], cursor: dict | None, filters: dict, limit: int) -> tuple[list, dict | None]:
    """A page of rows and the cursor of the next; a cursor only goes with the filters it came from."""
    if cursor is not None and cursor["filters"] != filters:
        raise ValueError("the cursor belongs to other filters")
    for k, v in filters.items():
        df = df.where(F.col(k) == v)
    if cursor is not None:
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, cursor["after"])]))
    rows = df.orderBy(*order).limit(limit + 1).collect()
    more = len(rows) > limit
    return rows[:limit], {"filters": filters, "after": [rows[limit - 1][c] for c in order]} if more else None
