"""The engine: log tables kept as Parquet under a warehouse, with snapshots, views, history and SQL.

Layout of a table: ``{warehouse}/{topic}/data`` holds records partitioned by range and bucket, ``files``
and ``sketches`` the files' metadata and distinct-count sketches (one Parquet directory for each commit),
``snapshots/{id}.json`` the commits and ``table.json`` the table's settings. A commit counts once its
snapshot file exists, which names the commit's metadata; that file is created only if it is not there
yet, so of two writers one has to try again, and what a broken commit left behind is never read and
collected later. All paths go through Spark's file system layer.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.buckets import bucket, bucket_ended
from tideframe.operators import grouping, planning, pruning, stats, tiering
from tideframe.operators.schema import Registry, widened_columns
from tideframe.operators.paths import tail_snapshot_id
from tideframe.sources.decode import decoded
from tideframe.sources.log import FIXED, browse, millis, offset_at, record_bytes
from tideframe.streaming.ingest import follow

VIEWS = ("merged", "stream", "lake")
#: What a task reads of a commit's files for their statistics.
SPLIT_BYTES = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a table, with their defaults."""

    file_bytes: int = 128 << 20
    file_window_ms: int = 60_000
    backfill_offsets: int = 100_000
    granularity: str = "hour"
    snapshot_retention_ms: int = 24 * 3_600_000
    collection_grace_ms: int = 3_600_000
    assembly_delay_ms: int = 10 * 60_000
    assembled_bytes: int = 1 << 30
    tier_bytes: int = 256 << 20
    tier_after_ms: int = 3_600_000


class Conflict(RuntimeError):
    """Another commit came first."""


class Files:
    """Small files through Hadoop's file system API, wherever the warehouse lies."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.conf), path

    def write(self, name: str, text: str, replace_old: bool = False) -> None:
        fs, path = self._path(name)
        if not replace_old and fs.exists(path):
            raise Conflict(name)
        try:
            out = fs.create(path, replace_old)
        except Exception as e:
            raise Conflict(name) from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        fs, path = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def modified(self, name: str) -> list[tuple[str, int]]:
        """Name and time of change (ms) of what a folder holds."""
        fs, path = self._path(name)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)


_FILE = "partition int, start long, end long, spec int, bucket int, schema int, records long, bytes long, first_ts_ms long, added long, replaced long, location string, lower_offset long, upper_offset long, lower_ts timestamp_ntz, upper_ts timestamp_ntz, bounds map<string,struct<lower:string,upper:string>>"


class Engine:
    """Tables of one warehouse."""

    def __init__(self, spark: SparkSession, warehouse: str, config: EngineConfig | None = None) -> None:
        self.spark, self.warehouse, self.config = spark, warehouse.rstrip("/"), config or EngineConfig()
        self.store = Files(spark, self.warehouse)

    # -- tables ------------------------------------------------------------------------------------

    def add_table(self, topic: str, partitions: int, topic_id: str | None = None, **settings) -> dict:
        config = asdict(replace(self.config, **settings))
        table = {"topic": topic, "id": topic_id or str(uuid.uuid4()), "partitions": partitions, "state": "indexing", "config": config, "specs": [config["granularity"]], "history": None, "generation": 0}
        self.store.write(f"{topic}/table.json", json.dumps(table))
        return table

    def table(self, topic: str) -> dict:
        text = self.store.read(f"{topic}/table.json")
        if text is None:
            raise KeyError(topic)
        return json.loads(text)

    def _change(self, topic: str, **changes) -> dict:
        table = self.table(topic) | changes
        self.store.write(f"{topic}/table.json", json.dumps(table), True)
        return table

    def list_tables(self, state: str | None = "indexing") -> list[str]:
        found = [t for t in self.store.list("") if self.store.read(f"{t}/table.json") is not None]
        return [t for t in found if state is None or self.table(t)["state"] == state]

    def remove_table(self, topic: str, now_ms: int | None = None) -> None:
        self._change(topic, state="removing", removed_ms=now_ms if now_ms is not None else int(time.time() * 1000))

    def purge(self, now_ms: int) -> list[str]:
        """Delete the tables that were removed longer ago than their collection grace."""
        marked = [self.table(t) for t in self.list_tables("removing")]
        gone = [t["topic"] for t in marked if t["removed_ms"] < now_ms - t["config"]["collection_grace_ms"]]
        for topic in gone:
            self.store.delete(topic)
        return gone

    def refresh(self, topic: str, topic_id: str | None, partitions: int = 0) -> str:
        """The table's state after a look at its topic: no id is missing, another id is replaced, more
        partitions are adopted, fewer are an error that changes nothing; removing is final."""
        t = self.table(topic)
        if t["state"] == "removing":
            return "removing"
        if topic_id is None or topic_id != t["id"]:
            return self._change(topic, state="missing" if topic_id is None else "replaced")["state"]
        if partitions < t["partitions"]:
            raise ValueError(f"{topic} has {partitions} partitions, {t['partitions']} are known")
        return self._change(topic, state="indexing", partitions=partitions)["state"]

    def set_granularity(self, topic: str, granularity: str) -> int:
        """The id of the current time spec; a new one only if the granularity changes."""
        specs = self.table(topic)["specs"]
        if specs[-1] != granularity:
            self._change(topic, specs=[*specs, granularity])
            return len(specs)
        return len(specs) - 1

    def attach(self, topic: str, location: str, ends: dict[int, int] | None = None) -> int:
        """Attach a history table; ends are the offsets that it holds already, each a file boundary.

        A history that holds data already must have the table's columns. Snapshots that read an earlier
        history are forgotten first."""
        for other in self.list_tables(None):
            held = self.table(other)["history"]
            if held and (held["location"] + "/").startswith(location.rstrip("/") + "/") | (location.rstrip("/") + "/").startswith(held["location"] + "/"):
                raise ValueError(f"{location} overlaps the history of {other}")
        ends = {str(p): o for p, o in (ends or {}).items()}
        if ends:
            bounds = {(r.partition, r.end) for r in self.files(topic).select("partition", "end").distinct().collect()}
            if not all(o == 0 or (int(p), o) in bounds for p, o in ends.items()):
                raise ValueError("a history must end between files")
        last = self._latest(topic)
        if last:
            try:
                held = self.spark.read.parquet(location)
            except AnalysisException:  # nothing is there yet
                held = None
            if held is not None:
                by_name = lambda kind: T.StructType(sorted((f for f in kind if not f.name.startswith("_part_")), key=lambda f: f.name))
                tiering.check_history(by_name(held.schema), by_name(self.load(topic, "stream", last["id"]).schema), 2, len(self.table(topic)["specs"]) - 1, 0)
        earlier = [s["id"] for s in self._snapshots(topic) if s["history"]]
        if earlier:
            self._change(topic, history=None)
            if earlier[-1] == last["id"]:
                self._snapshot(topic, last["id"] + 1, last["offsets"], [], None)
            self._forget(topic, [s["id"] for s in self._snapshots(topic) if s["id"] <= earlier[-1]])
        generation = self.table(topic)["generation"] + 1
        self._change(topic, history={"location": location.rstrip("/"), "ends": ends}, generation=generation)
        return generation

    def detach(self, topic: str) -> None:
        self._change(topic, history=None)

    # -- writing -----------------------------------------------------------------------------------

    def ingest(self, topic: str, records: DataFrame, now_ms: int | None = None, stable: dict[int, int] | None = None, mark: dict | None = None) -> int:
        """Index records (the fixed columns, and more) and commit; returns the snapshot.

        Records are cut into ranges by size and time span, and each range into files by bucket. With
        stable (offset by partition) a partition is indexed from its indexed end to there, so offsets
        without a record belong to the ranges beside them; records before the indexed end are an error.
        mark is kept with the snapshot."""
        t = self.table(topic)
        spec = len(t["specs"]) - 1
        grain = t["specs"][spec]
        rows = records.withColumns(
            {"partition": F.col("_kafka_partition"), "offset": F.col("_kafka_offset"), "ts_ms": millis(F.col("_kafka_timestamp")), "size": record_bytes()}
        ).withColumn("bucket", bucket(F.col("ts_ms"), grain))
        ranges = grouping.file_ranges(rows, t["config"]["file_bytes"], t["config"]["file_window_ms"])
        if stable is not None:
            last = self._latest(topic)
            ends = {int(p): e for p, (_, e) in last["offsets"].items()} if last else {}
            early = [(p, s) for p, group, s, _, _ in ranges if group == 0 and p in stable and s < ends.get(p, 0)]
            if early:
                raise ValueError(f"records before the indexed end: partition {early[0][0]}, offset {early[0][1]}")
            ranges = [
                (p, group, ends.get(p, s) if group == 0 and p in stable else s, max(e, stable.get(p, e)) if trailing else e, trailing)
                for p, group, s, e, trailing in ranges
            ]
        placed = grouping.in_ranges(rows, [(p, s, e) for p, _, s, e, _ in ranges])
        return self._commit(topic, placed, spec, [], now_ms, mark=mark)

    def ingest_typed(self, topic: str, records: DataFrame, make, now_ms: int | None = None) -> int:
        """Index records with their values decoded into columns; a value that does not decode stays in _kafka_value.

        make() gives the decoder. Columns that later schemas add are null in earlier files; int and float
        columns may widen to long and double, other changes of a column's type are an error."""
        out = decoded(records, "_kafka_value", make)
        fields = out.schema["decoded"].dataType.fieldNames()
        if taken := set(fields) & {*records.columns, "raw"}:
            raise ValueError(f"reserved column {sorted(taken)[0]!r}")
        rest = [F.col(c) for c in records.columns if c != "_kafka_value"]
        return self.ingest(topic, out.select(*rest, F.col("raw").alias("_kafka_value"), *[F.col(f"decoded.`{f}`") for f in fields]), now_ms)

    def follow(self, topic: str, path: str, checkpoint: str, poll_ms: int | None = None, files_per_batch: int = 100):
        """Index the log files (of the fixed columns) that arrive in a directory, one commit a batch.

        Files must arrive in the order of their offsets: records behind the indexed end stop the stream with
        an error. A batch that is repeated after a failure is known by its number and changes nothing."""

        def index(records: DataFrame, batch: int) -> None:
            last = self._latest(topic)
            if last and last.get("mark") and last["mark"].get(checkpoint, -1) >= batch:
                return
            tops = records.groupBy("_kafka_partition").agg(F.max("_kafka_offset").alias("top")).collect()  # one row a log partition
            if tops:
                seen = (last.get("mark") if last else None) or {}
                self.ingest(topic, records, stable={r["_kafka_partition"]: r.top + 1 for r in tops}, mark=seen | {checkpoint: batch})

        return follow(self.spark, FIXED, path, checkpoint, index, poll_ms, files_per_batch)

    def _commit(self, topic: str, placed: DataFrame, spec: int, replaced: list[str], now_ms: int | None, offsets: dict | None = None, mark: dict | None = None) -> int:
        """Write rows with partition, start, end, bucket, ts_ms and size as files of the next snapshot."""
        last = self._latest(topic)
        number = last["id"] + 1 if last else 1
        location = f"{topic}/data/{number}-{uuid.uuid4().hex}"
        keys = ["partition", "start", "end", "bucket"]
        data = f"{self.warehouse}/{location}"
        # a large file's rows, or those of files that meet in one task, are spread over several tasks: a file is a folder of parts
        tidy = placed.withColumn("bucket", F.coalesce("bucket", F.lit(0))).hint("rebalance", *keys).sortWithinPartitions(*keys, "offset")
        tidy.drop("offset").write.partitionBy(*keys).parquet(data)
        back = self.spark.read.parquet(data)
        own = {"partition", "start", "end", "bucket", "ts_ms", "size"}
        table = self.table(topic)
        kept = widened_columns(T.StructType.fromJson(table["schema"]) if table.get("schema") else T.StructType(), T.StructType([f for f in back.schema if f.name not in own]))
        bounds, columns = stats.file_bounds(back.schema, {*FIXED.fieldNames(), *own})
        measured = back.groupBy("partition", "start", "end", "bucket").agg(
            F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"), F.min("ts_ms").alias("first_ts_ms"), F.min("_kafka_offset").alias("lower_offset"),
            F.max("_kafka_offset").alias("upper_offset"), F.min("_kafka_timestamp").alias("lower_ts"), F.max("_kafka_timestamp").alias("upper_ts"), bounds.alias("bounds"),
        )
        if columns.items() - table.get("columns", {}).items() or kept.jsonValue() != table.get("schema"):
            self._change(topic, columns=table.get("columns", {}) | columns, schema=kept.jsonValue())
        none = table["specs"][spec] == "none"
        where = F.concat(F.lit(f"{location}/partition="), "partition", F.lit("/start="), "start", F.lit("/end="), "end", F.lit("/bucket="), "bucket")
        rows = measured.withColumns({"location": where, "spec": F.lit(spec), "schema": F.lit(0), "added": F.lit(number), "replaced": F.lit(None)})
        if none:
            rows = rows.withColumn("bucket", F.lit(None))
        kinds = T.StructType.fromDDL(_FILE)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        name = f"{number}-{uuid.uuid4().hex}"
        with self._small_splits():
            rows.repartition(1).write.parquet(f"{self.warehouse}/{topic}/files/{name}")
            rows = self.spark.read.schema(kinds).parquet(f"{self.warehouse}/{topic}/files/{name}")
            if rows.isEmpty():
                self.store.delete(f"{topic}/files/{name}")
                return last["id"] if last else 0
            if not replaced:  # what is put together was counted when it came
                flat = [f.name for f in kept if f.name in back.columns and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
                day = F.col("_kafka_timestamp").cast("date")
                stats.sketches(back, day, flat).write.parquet(f"{self.warehouse}/{topic}/sketches/{name}")
        if offsets is None:
            found = rows.groupBy("partition").agg(F.min("start").alias("s"), F.max("end").alias("e")).collect()
            offsets = {p: list(x) for p, x in (last["offsets"] if last else {}).items()}
            for r in found:
                held = offsets.setdefault(str(r.partition), [r.s, r.e])
                if held[1] not in (r.s, r.e) and held[0] != r.e:
                    raise ValueError(f"range {r.s}-{r.e} does not touch {held[0]}-{held[1]} of partition {r.partition}")
                offsets[str(r.partition)] = [min(held[0], r.s), max(held[1], r.e)]
        self._snapshot(topic, number, offsets, replaced, now_ms, [name], mark)
        return number

    @contextmanager
    def _small_splits(self):
        """Statistics sort what a task reads, by file and by day; so tasks read little, whatever the table's size."""
        held = self.spark.conf.get(_SPLIT)
        self.spark.conf.set(_SPLIT, min(SPLIT_BYTES, self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
        try:
            yield
        finally:
            self.spark.conf.set(_SPLIT, held)

    def _snapshot(self, topic: str, number: int, offsets: dict, replaced: list[str], now_ms: int | None, files: list[str] | None = None, mark: dict | None = None) -> None:
        last = self._latest(topic)
        if last and number <= last["id"]:
            raise Conflict(f"snapshot {number}")
        if last and any(offsets.get(p, [0, -1])[1] < e for p, (_, e) in last["offsets"].items()):
            raise ValueError("ends never move back and partitions never disappear")
        history = self.table(topic)["history"]
        body = {"id": number, "committed_ms": now_ms if now_ms is not None else int(time.time() * 1000), "offsets": offsets, "replaced": replaced, "history": history}
        body |= {"files": files or [], "mark": mark or (last or {}).get("mark")}
        self.store.write(f"{topic}/snapshots/{number:020d}.json", json.dumps(body))

    # -- reading -----------------------------------------------------------------------------------

    def _snapshots(self, topic: str) -> list[dict]:
        return [json.loads(self.store.read(f"{topic}/snapshots/{n}")) for n in self.store.list(f"{topic}/snapshots")]

    def _latest(self, topic: str) -> dict | None:
        names = self.store.list(f"{topic}/snapshots")
        return json.loads(self.store.read(f"{topic}/snapshots/{names[-1]}")) if names else None

    def snapshots(self, topic: str) -> DataFrame:
        rows = [(s["id"], s["committed_ms"], json.dumps(s["offsets"])) for s in self._snapshots(topic)]
        return self.spark.createDataFrame(rows, "id long, committed_ms long, offsets string")

    def offsets(self, topic: str) -> DataFrame:
        rows = [(s["id"], int(p), a, b) for s in self._snapshots(topic) for p, (a, b) in s["offsets"].items()]
        return self.spark.createDataFrame(rows, "id long, partition int, start long, end long")

    def files(self, topic: str, partition: int | None = None, bucket_no: int | None = None) -> DataFrame:
        """All known files, each with the snapshot that replaced it, if one did."""
        known = self._snapshots(topic)
        names = [n for s in known for n in s["files"]]
        if not names:
            return self.spark.createDataFrame([], _FILE)
        out = self.spark.read.schema(_FILE).parquet(*[f"{self.warehouse}/{topic}/files/{n}" for n in names])
        gone = [(loc, s["id"]) for s in known for loc in s["replaced"]]
        dropped = self.spark.createDataFrame(gone, "location string, _by long")
        out = out.join(dropped, "location", "left").withColumn("replaced", F.col("_by")).drop("_by")
        if partition is not None:
            out = out.where(F.col("partition") == partition)
        return out if bucket_no is None else out.where(F.col("bucket") == bucket_no)

    def _read(self, topic: str, files: DataFrame) -> DataFrame | None:
        places = [r.location for r in files.select("location").collect()]
        if not places:
            return None
        kept = T.StructType.fromJson(self.table(topic)["schema"])
        return self.spark.read.schema(kept).parquet(*[f"{self.warehouse}/{p}" for p in places])

    def matching(self, topic: str, files: DataFrame, domains: dict) -> DataFrame:
        """The files whose bounds allow rows in all domains; a domain by _kafka_partition or any column of the table counts."""
        names, kinds, by = {"_kafka_offset": "offset", "_kafka_timestamp": "ts"}, self.table(topic).get("columns", {}), {}
        for name, domain in domains.items():
            if name == "_kafka_partition":
                files = files.withColumns({"lower_partition": F.col("partition"), "upper_partition": F.col("partition")})
                by["partition"] = domain
            elif name in kinds:
                bound = F.col("bounds")[name]
                files = files.withColumns({f"lower_{name}": bound["lower"].cast(kinds[name]), f"upper_{name}": bound["upper"].cast(kinds[name])})
                by[name] = domain
            elif name in names:
                by[names[name]] = domain
        return pruning.pruned(files, by)

    def load(self, topic: str, view: str = "merged", as_of: int | None = None, as_of_timestamp: int | None = None, tail: DataFrame | None = None, domains: dict | None = None) -> DataFrame:
        """A view of one snapshot: the log, its history, or both with each record once.

        tail: records past the snapshot that are not committed yet. domains (by column) leave out files
        whose bounds cannot match; rows are not filtered by them."""
        if view not in VIEWS:
            raise ValueError(f"no view {view!r}")
        known = self._snapshots(topic)
        if as_of_timestamp is not None:
            known = [s for s in known if s["committed_ms"] <= as_of_timestamp]
        s = next((x for x in known if x["id"] == as_of), None) if as_of is not None else known[-1] if known else None
        if s is None:
            if as_of is not None or as_of_timestamp is not None:
                raise KeyError(f"no snapshot {as_of or as_of_timestamp} of {topic}")
            base = self.spark.createDataFrame([], FIXED)
            return base if tail is None or view == "lake" else tail
        ends = {int(p): e for p, e in (s["history"] or {"ends": {}})["ends"].items()}
        parts = []
        cut = reduce(lambda a, b: a | b, [(F.col("_kafka_partition") == p) & (F.col("_kafka_offset") < e) for p, e in ends.items()], F.lit(False))
        if view != "lake":
            files = planning.files_of(self.files(topic), self.offsets(topic), s["id"])
            log = self._read(topic, self.matching(topic, files, domains or {}))
            if log is not None:
                parts.append(log.where(~cut))
            if tail is not None:
                past = reduce(lambda a, b: a | b, [(F.col("_kafka_partition") == int(p)) & (F.col("_kafka_offset") < e) for p, (_, e) in s["offsets"].items()], F.lit(False))
                parts.append(tail.where(~past))
        if view != "stream" and s["history"] and ends:
            lake = self.spark.read.parquet(s["history"]["location"])
            parts.append(lake.select(*[c for c in lake.columns if not c.startswith("_part_")]).where(cut))
        if not parts:
            return self.spark.createDataFrame([], FIXED)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def tail_id(self, topic: str, stable: dict[int, int]) -> int:
        """Id of the snapshot extended to the last stable offsets; the committed id if nothing is new."""
        s = self._latest(topic)
        ends = {int(p): e for p, (_, e) in s["offsets"].items()} if s else {}
        new = [(p, ends.get(p, 0), e) for p, e in stable.items() if e > ends.get(p, 0)]
        return tail_snapshot_id(new) if new or not s else s["id"]

    def register(self, topic: str, tail: DataFrame | None = None) -> None:
        """Temporary views merged_{topic}, stream_{topic} and lake_{topic} of one snapshot."""
        s = self._latest(topic)
        for v in VIEWS:
            self.load(topic, v, s["id"] if s else None, tail=tail).createOrReplaceTempView(f"{v}_{topic}")

    def namespaces(self) -> list[str]:
        return list(VIEWS)

    def tables(self, namespace: str) -> list[str]:
        if namespace not in VIEWS:
            raise KeyError(namespace)
        return self.list_tables()

    def tables_page(self, namespace: str, limit: int = 50, token: str | None = None) -> tuple[list[str], str | None]:
        """At most limit lower-case table names after the token's, sorted, and the next page's token, None at the end."""
        names = sorted({t.lower() for t in self.tables(namespace)})
        rest = [t for t in names if token is None or t > token]
        return rest[:limit], rest[limit - 1] if len(rest) > limit else None

    def capabilities(self) -> dict[str, list[str]]:
        """What a scan does by itself; aggregates, joins and other expressions are left to the query engine."""
        return {"filter": ["sorted ranges", "sets of equal values", "nullable comparison"], "limit": ["integer constant"], "top_n": ["order by"]}

    def schema(self, topic: str, view: str = "merged") -> T.StructType:
        return self.load(topic, view).schema

    def partitions(self, topic: str) -> DataFrame:
        live = self.files(topic).where("replaced is null")
        return live.groupBy("partition").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))

    def records(self, topic: str, partition: int, offset: int = 0, limit: int = 50) -> DataFrame:
        return browse(self.load(topic), partition, offset, limit)

    def records_page(self, topic: str, partition: int, offset: int | None = None, timestamp=None, limit: int = 50, span: int = 10) -> tuple[DataFrame, int | None]:
        """A page of a partition's records from an offset, a time or the indexed start on, and the next page's offset.

        The start is brought inside the indexed offsets; the page ends after limit records or span times as
        many offsets. The next offset is None once the page reaches the indexed end."""
        limit = min(max(limit, 1), 500)
        s = self._latest(topic)
        first, end = s["offsets"].get(str(partition), (0, 0)) if s else (0, 0)
        log = self.load(topic)
        if offset is None and timestamp is not None:
            found = offset_at(log.where(F.col("_kafka_partition") == partition), F.lit(timestamp)).first()
            offset = found.offset if found else end
        start = min(max(first if offset is None else offset, first), end)
        page = browse(log, partition, start, limit, span).persist()
        n, last = page.agg(F.count(F.lit(1)), F.max("_kafka_offset")).first()
        following = last + 1 if n == limit else min(start + span * limit, end)
        return page, following if following < end else None

    def overview(self, stable: DataFrame) -> DataFrame:
        """Lag, records and bytes of each table, most lagging first; stable(topic, partition, stable)."""
        parts = [self.partitions(t).withColumn("topic", F.lit(t)) for t in self.list_tables()]
        if not parts:
            return self.spark.createDataFrame([], "topic string, lag long, records long, bytes long")
        both = reduce(DataFrame.unionByName, parts).join(stable, ["topic", "partition"])
        lag = F.sum(F.greatest(F.col("stable") - F.col("end"), F.lit(0)))
        return both.groupBy("topic").agg(lag.alias("lag"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).orderBy(F.desc("lag"), "topic").limit(10)

    def sql(self, text: str, max_rows: int = 1000) -> tuple[list, bool]:
        """The first rows of a query, and whether there are more."""
        rows = self.spark.sql(text).limit(max_rows + 1).collect()
        return rows[:max_rows], len(rows) > max_rows

    def profile(self, text: str) -> list[dict]:
        return pruning.profile(self.spark.sql(text))

    def column_stats(self, topic: str, mode: str = "truncate") -> DataFrame:
        return stats.column_stats(self.load(topic, "stream").drop("_kafka_headers"), ["_kafka_partition"], mode=mode)

    def distinct_counts(self, topic: str) -> DataFrame:
        """field and its estimated number of distinct values, from the sketches of days that the table still has."""
        known = self._snapshots(topic)
        held = set(self.store.list(f"{topic}/sketches"))
        names = [n for s in known for n in s["files"] if n in held]
        if not names:
            return self.spark.createDataFrame([], "field string, ndv long")
        first = planning.files_of(self.files(topic), self.offsets(topic), known[-1]["id"]).agg(F.min("first_ts_ms")).first()[0]
        sketched = self.spark.read.parquet(*[f"{self.warehouse}/{topic}/sketches/{n}" for n in names])
        return stats.distinct_counts(stats.trimmed(sketched, F.date_from_unix_date(F.lit((first or 0) // 86_400_000).cast("int"))))

    def summary(self, topic: str, snapshot: int) -> DataFrame:
        """What a snapshot added and deleted against the one before it, and its totals."""
        ids = [s["id"] for s in self._snapshots(topic) if s["id"] <= snapshot]
        if not ids or ids[-1] != snapshot:
            raise KeyError(f"no snapshot {snapshot} of {topic}")
        files, offsets = self.files(topic), self.offsets(topic)
        before = planning.files_of(files, offsets, ids[-2]) if len(ids) > 1 else files.where("false")
        return planning.commit_summary(before, planning.files_of(files, offsets, snapshot))

    def manifests(self, topic: str) -> DataFrame:
        """The latest snapshot's files by spec, bucket and commit: count and range of offsets."""
        s = self._latest(topic)
        return planning.manifests(planning.files_of(self.files(topic), self.offsets(topic), s["id"]) if s else self.files(topic))

    # -- schemas -----------------------------------------------------------------------------------

    def add_schema(self, schema_id: str, schema: T.StructType, subject: str | None = None, references: list[str] | None = None) -> None:
        """Keep a schema with the warehouse; what is known of an id already does not change."""
        name = f"_schemas/{schema_id}.json"
        held = json.loads(self.store.read(name) or json.dumps({"id": schema_id, "schema": schema.jsonValue(), "references": references or [], "subjects": []}))
        held["subjects"] = sorted({*held["subjects"], *([subject] if subject else [])})
        self.store.write(name, json.dumps(held), True)

    def registry(self) -> Registry:
        """The schemas kept with the warehouse."""
        out = Registry()
        for n in self.store.list("_schemas"):
            held = json.loads(self.store.read(f"_schemas/{n}"))
            for subject in held["subjects"] or [None]:
                out.add(held["id"], T.StructType.fromJson(held["schema"]), subject, held["references"])
        return out

    # -- upkeep ------------------------------------------------------------------------------------

    def compact(self, topic: str, now_ms: int) -> int:
        """Put files of ended buckets together; readers of earlier snapshots still see the parts."""
        t, s = self.table(topic), self._latest(topic)
        files = planning.files_of(self.files(topic), self.offsets(topic), s["id"])
        for p, end in (t["history"] or {"ends": {}})["ends"].items():  # what is tiered is not put together any more
            files = files.where((F.col("partition") != int(p)) | (F.col("start") >= end))
        last = s["id"]
        for spec, grain in enumerate(t["specs"]):
            if grain == "none":
                continue
            mine = files.where(F.col("spec") == spec)
            runs = planning.assembly_runs(mine, t["config"]["assembled_bytes"], bucket_ended(F.col("bucket"), grain, now_ms - t["config"]["assembly_delay_ms"]))
            runs = runs.select("partition", F.col("bucket").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
            parts = mine.join(runs, (mine.partition == runs.partition) & mine.bucket.eqNullSafe(runs["_b"]) & planning.covers(runs["_s"], runs["_e"], mine.start, mine.end)).drop(runs.partition)
            rows = parts.select("location", "partition", "_s", "_e", "_b").collect()
            if not rows:
                continue
            kept = T.StructType([*T.StructType.fromJson(self.table(topic)["schema"]), T.StructField("ts_ms", T.LongType()), T.StructField("size", T.LongType())])
            data = self.spark.read.schema(kept).parquet(*[f"{self.warehouse}/{r.location}" for r in rows])
            # files of several commits share no base path, so their place is read from their names
            of = lambda key: F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=(-?\\d+)/", 1)
            data = data.withColumns({"partition": of("partition").cast("int"), "start": of("start").cast("long"), "bucket": of("bucket").cast("int")})
            place = self.spark.createDataFrame([(r.partition, r["_b"], int(r.location.split("start=")[1].split("/")[0]), r["_s"], r["_e"]) for r in rows], "partition int, bucket int, start long, s long, e long").distinct()
            placed = data.withColumn("offset", F.col("_kafka_offset")).join(place, ["partition", "bucket", "start"]).drop("start", "end").withColumnsRenamed({"s": "start", "e": "end"})
            last = self._commit(topic, placed, spec, [r.location for r in rows], now_ms, s["offsets"])
        return last

    def expire(self, topic: str, now_ms: int, earliest: dict[int, int] | None = None) -> list[int]:
        """Forget old snapshots; the latest always stays."""
        known = self.spark.createDataFrame(list((earliest or {}).items()), "partition int, earliest long")
        gone = planning.expired_snapshots(self.snapshots(topic), self.offsets(topic), now_ms, self.table(topic)["config"]["snapshot_retention_ms"], known)
        return self._forget(topic, sorted(r.id for r in gone.collect()))

    def _forget(self, topic: str, ids: list[int]) -> list[int]:
        """Delete snapshots, oldest first; what they added and replaced is from then on stated by the first that stays."""
        for i in ids:
            body = json.loads(self.store.read(f"{topic}/snapshots/{i:020d}.json"))
            if body["replaced"] or body["files"]:
                first = next(s for s in self._snapshots(topic) if s["id"] not in ids)
                first["replaced"] = sorted({*first["replaced"], *body["replaced"]})
                first["files"] = sorted({*first["files"], *body["files"]})
                self.store.write(f"{topic}/snapshots/{first['id']:020d}.json", json.dumps(first), True)
            self.store.delete(f"{topic}/snapshots/{i:020d}.json")
        return ids

    def trim(self, topic: str, earliest: dict[int, int], now_ms: int | None = None) -> dict[int, int]:
        """Move starts up to what the log still has (its earliest offset by partition), never inside a file; returns those moved."""
        s = self._latest(topic)
        files = planning.files_of(self.files(topic), self.offsets(topic), s["id"])
        known = self.spark.createDataFrame(list(earliest.items()), "partition int, earliest long")
        starts = {r.partition: r.start for r in planning.retained_starts(files, known).collect()}  # one row a log partition
        moved = {p: n for p, n in starts.items() if n > s["offsets"][str(p)][0]}
        if moved:
            self._snapshot(topic, s["id"] + 1, {p: [moved.get(int(p), a), e] for p, (a, e) in s["offsets"].items()}, [], now_ms)
        return moved

    def collect(self, topic: str, now_ms: int | None = None) -> list[str]:
        """Delete files that no snapshot reads, and what no commit names once it is older than the grace.

        Starts only move up and snapshots are forgotten oldest first, so the oldest one left decides."""
        known = self._snapshots(topic)
        first = known[0] if known else {"id": 0, "offsets": {}}
        files = self.files(topic)
        before = reduce(lambda a, b: a | b, [(F.col("partition") == int(p)) & (F.col("start") < a) for p, (a, _) in first["offsets"].items()], F.lit(False))
        unread = files.where((F.coalesce("replaced", F.lit(1 << 62)) <= first["id"]) | ((F.col("added") <= first["id"]) & before))
        gone = [r.location for r in unread.select("location").collect()]
        now = now_ms if now_ms is not None else int(time.time() * 1000)
        listed = [(f"{topic}/{kind}/{n}", at) for kind in ("data", "files", "sketches") for n, at in self.store.modified(f"{topic}/{kind}")]
        if listed:  # one folder a commit
            named = [(f"{topic}/{kind}/{n}",) for s in known for n in s["files"] for kind in ("files", "sketches")]
            referenced = files.select(F.substring_index("location", "/", topic.count("/") + 3).alias("path")).distinct().unionByName(self.spark.createDataFrame(named, "path string"))
            unknown = planning.collectable(self.spark.createDataFrame(listed, "path string, modified_ms long"), referenced, now, self.table(topic)["config"]["collection_grace_ms"])
            gone += [r.path for r in unknown.collect()]
        for place in gone:
            self.store.delete(place)
        return gone

    def tier(self, topic: str, now_ms: int, partition: list[str] | None = None, sort: list[str] | None = None, **properties) -> dict[int, int]:
        """Move old records to the attached history and commit its new ends."""
        t, s = self.table(topic), self._latest(topic)
        if not t["history"]:
            raise ValueError(f"{topic} has no history")
        ends = {int(p): e for p, e in t["history"]["ends"].items()}
        starts = self.spark.createDataFrame([(int(p), ends.get(int(p), a)) for p, (a, _) in s["offsets"].items()], "partition int, start long")
        files = planning.files_of(self.files(topic), self.offsets(topic), s["id"])
        pieces = planning.tier_pieces(files, starts, now_ms - t["config"]["tier_after_ms"])
        flushes = planning.tier_flushes(pieces, now_ms - t["config"]["tier_after_ms"], t["config"]["tier_bytes"]).collect()
        if not flushes:
            return ends
        new = dict(ends)
        for f in sorted(flushes, key=lambda r: (r.partition, r.start)):
            new[f.partition] = f.end
        log = self.load(topic, "stream", s["id"])
        take = reduce(lambda a, b: a | b, [(F.col("_kafka_partition") == f.partition) & (F.col("_kafka_offset") >= f.start) & (F.col("_kafka_offset") < f.end) for f in flushes])
        self._change(topic, tiering={str(p): e for p, e in new.items()})
        tiering.write_history(log.where(take), t["history"]["location"], partition or [], sort or [], **properties)
        return self._settle(topic, new, now_ms)

    def _settle(self, topic: str, ends: dict[int, int], now_ms: int) -> dict[int, int]:
        """Commit the history's new ends; from this snapshot on the log is cut there."""
        t, s = self.table(topic), self._latest(topic)
        self._change(topic, history={"location": t["history"]["location"], "ends": {str(p): e for p, e in ends.items()}}, tiering=None)
        self._snapshot(topic, s["id"] + 1, s["offsets"], [], now_ms)
        return ends

    def recover_tier(self, topic: str, now_ms: int) -> dict[int, int]:
        """Finish or undo a tiering that broke off between its write and its commit.

        A write that is whole (the history holds every record of the planned ranges) is committed. Of
        any other nothing can be read, since the ends did not move; its rows are taken out again."""
        t, s = self.table(topic), self._latest(topic)
        ends = {int(p): e for p, e in t["history"]["ends"].items()}
        planned = {int(p): e for p, e in (t.get("tiering") or {}).items()}
        if not planned:
            return ends
        past = reduce(lambda a, b: a | b, [(F.col("_kafka_partition") == p) & (F.col("_kafka_offset") >= ends.get(p, 0)) & (F.col("_kafka_offset") < e) for p, e in planned.items()])
        count = lambda df: (df.count(), df.select("_kafka_partition", "_kafka_offset").distinct().count())
        want = self.load(topic, "stream", s["id"]).where(past).count()
        try:
            lake = self.spark.read.parquet(t["history"]["location"])
            found = count(lake.where(past))
        except AnalysisException:
            lake, found = None, (0, 0)
        if found == (want, want):
            return self._settle(topic, planned, now_ms)
        if found[0]:
            location = f"{t['history']['location']}-{uuid.uuid4().hex}"
            names = [c for c in lake.columns if c.startswith("_part_")]
            lake.where(~past).write.partitionBy(*names).parquet(location)
            self._change(topic, history={"location": location, "ends": t["history"]["ends"]})
        self._change(topic, tiering=None)
        return ends
