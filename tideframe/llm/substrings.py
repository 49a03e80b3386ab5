"""Removal of repeated passages: every byte inside a 100-byte string that also starts earlier.

Exact, and without shuffling one row for each byte:

1. Anchors. Each 100-byte window of a text points to the least (by hash) of the 24-byte strings in
   it, leftmost on ties. Equal windows point to equal strings at equal places, so only windows of
   one anchor string have to be compared: about one row for 38 bytes. A row holds the hash of the
   anchor string, the hash of all bytes of the windows that point to it, and its place. Inside a
   task's batch rows with both hashes equal are settled at once; the earliest goes on.
2. Rows are dealt out and sorted by anchor. Where both hashes agree with an earlier row, all windows
   of the anchor are repeats. The earliest row of each kind is kept as a leader if its anchor
   string occurs again.
3. Leaders of an anchor string with differing surroundings fetch their bytes (one join with the
   texts). Blocks of them are sorted with a difference cover, one bucket (anchor and offset) at a time,
   see blocksort; windows equal to an earlier one are repeats. An anchor string with more than
   ``HOT`` leaders is never gathered: its windows are hashed (128 bits) and the earliest place of
   each hash is found by an aggregate that combines before its shuffle.
4. The repeats' ranges of each document are joined with the texts, merged and cut out.

Order is by doc_id, whatever its type, then by hash of the text where rows repeat a doc_id; null ids
come last. Rows equal in id and text are one document. Whole numbers stand for themselves; ids of any
other type are replaced by their ranks, which a range-partitioned sort counts. Null text counts as empty. Matches never cross documents.
``strip`` returns texts; a UTF-8 character that is cut in two there is dropped whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm.blocksort import LENGTH, PERIOD, Block
from tideframe.llm.common import POWERS, by_bytes, joined, lean, mix64, prefix_hash, range_hash, stored, table, text_bytes

ANCHOR = 24
SPAN = LENGTH - ANCHOR + 1
HOT = 16_384
#: Bytes whose anchors are found at once, and whose windows are sorted at once: numpy's temporaries take a hundred and
#: fifty times as much at the most. A group of one anchor string is never split, whatever its bytes.
PIECE = (1 << 18) - 1
BLOCK_BYTES = 1 << 20
OUT_ROWS = 20_000
_PLACE_BITS = np.uint64(23)
_LAST = (1 << 63) - 1


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchor hash, surroundings hash, text number, first window, further windows, and the anchor's
    distance from its first window, for each anchor of each text."""
    none = np.zeros(0, np.int64)
    if max(map(len, texts), default=0) > PIECE:
        return _long_anchors(texts)
    data, bounds = joined(texts)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    h = prefix_hash(data)
    _, down = POWERS.upto(len(h))
    code = mix64((h[ANCHOR:] - h[:-ANCHOR]) * down[: len(h) - ANCHOR])
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (code & ~low) | np.arange(len(code), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    start = np.arange(len(least))
    owner = np.searchsorted(bounds, start, "right") - 1
    inside = start + LENGTH <= bounds[owner + 1]
    start, owner, at = start[inside], owner[inside], (least[inside] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    lo, more, at, owner = start[first], start[last] - start[first], at[first], owner[first]
    around = mix64(range_hash(h, lo, lo + more + LENGTH) + (at - lo).astype(np.uint64))
    return code[at], around, owner, lo - bounds[owner], more, at - lo


def _long_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """anchors() of texts beyond a piece, cut in overlapping pieces with the windows of one piece each."""
    step = PIECE - LENGTH + 1
    found = []
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - LENGTH + 1, 1), step):
            code, around, _, lo, more, near = anchors([t[a : a + step + LENGTH - 1]])
            found.append((code, around, np.full(len(code), i), lo + a, more, near))
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_batch(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """df with function applied to each Arrow batch; what it gives goes to the executor ``OUT_ROWS`` rows at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                for k in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(k, OUT_ROWS)

    return df.mapInArrow(lean(run), schema)


def _packed(lo, more, near) -> np.ndarray:
    return (lo.astype(np.int64) << 16) | (more << 8) | near


def _rows(docs: DataFrame, twice: bool) -> DataFrame:
    """kind, code, around, doc, sub, place: kind 1 is to be compared, kind 0 is a repeat as a whole."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        subs = np.array([int.from_bytes(hashlib.md5(t).digest()[:7]) if twice else 0 for t in texts], np.int64)
        found = []
        for a, b in by_bytes(texts, PIECE):
            code, around, owner, lo, more, near = anchors(texts[a:b])
            found.append((code, around, ids[owner + a], subs[owner + a], _packed(lo, more, near)))
        del texts
        code, around, doc, sub, place = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((place, sub, doc, around, code))
        code, around, doc, sub, place = (x[order] for x in (code, around, doc, sub, place))
        same = np.zeros(len(code), bool)
        same[1:] = (code[1:] == code[:-1]) & (around[1:] == around[:-1])
        itself = same.copy()
        itself[1:] &= (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (place[1:] == place[:-1])
        keep = ~itself
        # repeats only pass through: spread them by place, not by anchor
        spread = mix64(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64))
        code = np.where(same, spread, code)
        arrays = [(~same)[keep], code[keep].view(np.int64), around[keep].view(np.int64), doc[keep], sub[keep], place[keep]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["fresh", "code", "around", "doc", "sub", "place"])

    return _by_batch(docs, find, "fresh boolean, code long, around long, doc long, sub long, place long")


def _stream(batches):
    """Of rows sorted by code, around, doc, sub, place: repeats (leader false) and leaders."""
    names = ["leader", "code", "doc", "sub", "place"]
    context = pending = None  # the row before the rows at hand, and the last row, which needs the one after it

    def out(leader, c):
        return pa.RecordBatch.from_arrays([pa.array(leader), *(pa.array(c[k]) for k in (0, 2, 3, 4))], names)

    def settle(c, start, stop):
        """Rows start to stop of the columns c; the rows beside them are there to be compared."""
        code, around = c[0], c[1]
        as_before = np.zeros(len(code), bool)
        as_before[1:] = code[1:] == code[:-1]
        repeat = as_before.copy()
        repeat[1:] &= around[1:] == around[:-1]
        as_after = np.append(as_before[1:], False)
        leader = ~repeat & (as_before | as_after)
        some = (repeat | leader)[start:stop]
        return out(leader[start:stop][some], [x[start:stop][some] for x in c])

    for batch in batches:
        fresh = batch.column(0).to_numpy(zero_copy_only=False)
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)]
        if not fresh.all():
            yield out(np.zeros((~fresh).sum(), bool), [x[~fresh] for x in c])
            c = [x[fresh] for x in c]
        head = [x for x in (context, pending) if x is not None]
        c = [np.concatenate([np.array([r[k] for r in head], np.int64), c[k]]) for k in range(5)]
        if len(c[0]) > 1:
            itself = np.zeros(len(c[0]), bool)
            itself[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in c])
            if itself.any():
                c = [x[~itself] for x in c]
        start = 0 if context is None else 1
        if len(c[0]) - 1 > start:
            yield settle(c, start, len(c[0]) - 1)
            context = [x[-2] for x in c]
            pending = [x[-1] for x in c]
        elif len(c[0]) > start:
            pending = [x[-1] for x in c]
    if pending is not None:
        head = [x for x in (context, pending) if x is not None]
        c = [np.array([r[k] for r in head], np.int64) for k in range(5)]
        yield settle(c, len(head) - 1, len(head))


def _windows(docs: DataFrame, leaders: DataFrame, hot: int) -> DataFrame:
    """doc, sub, lo, hi of the repeated windows among the leaders (code, doc, sub, place, n)."""
    per = leaders.groupBy("doc", "sub").agg(F.collect_list(F.struct("code", "place", "n")).alias("found"))
    held = docs.join(per, ["doc", "sub"]).select("doc", "text", "sub", "found")

    def cut(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            doc, subs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = batch.column(3)
            bounds = found.offsets.to_numpy()
            code, place, n = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            lists: list[list] = [[] for _ in range(6)]
            for i, t in enumerate(texts):
                for k in range(bounds[i], bounds[i + 1]):
                    p = int(place[k])
                    lo = p >> 16
                    for column, x in zip(lists, (code[k], n[k], doc[i], subs[i], p, t[lo : lo + ((p >> 8) & 255) + LENGTH])):
                        column.append(x)
                if len(lists[0]) >= OUT_ROWS:
                    yield _cut_rows(lists)
                    lists = [[] for _ in range(6)]
            yield _cut_rows(lists)

    rows = held.mapInArrow(lean(cut), "code long, n long, doc long, sub long, place long, bytes binary")
    rows = stored(rows)
    few = rows.where(F.col("n") <= hot).repartition("code").sortWithinPartitions("code", "doc", "sub", "place")
    out = few.mapInArrow(lean(_resolve), "doc long, sub long, lo long, hi long")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists: list[list] = [[] for _ in range(4)]
        for code, doc, sub, p, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            lo, more, near = p >> 16, (p >> 8) & 255, p & 255
            for j in range(more + 1):
                key = hashlib.md5(b"%d %d " % (code, near - j) + b[j : j + LENGTH]).digest()
                for column, x in zip(lists, (key, doc, sub, lo + j)):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(lists[0], pa.binary()), *(pa.array(x, pa.int64()) for x in lists[1:])], ["key", "doc", "sub", "at"])

    many = rows.where(F.col("n") > hot)
    if many.limit(1).count():
        each_window = stored(_by_batch(many, each, "key binary, doc long, sub long, at long"))
        earliest = each_window.groupBy("key").agg(F.min(F.struct("doc", "sub", "at")).alias("e"))
        later = each_window.join(earliest, "key").where(F.struct("doc", "sub", "at") > F.col("e"))
        out = out.unionByName(later.select("doc", "sub", F.col("at").alias("lo"), F.col("at").alias("hi")))
    return out


def _cut_rows(lists: list[list]) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in lists[:5]] + [pa.array(lists[5], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["code", "n", "doc", "sub", "place", "bytes"])


def _resolve(batches):
    """Repeated windows of sorted rows; whole anchors are gathered to blocks."""
    held: list[tuple] = []
    size = 0

    def solved():
        i, lo, hi = repeats([r[0] for r in held], [r[3] for r in held], [r[4] for r in held])
        docs, subs = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(docs[i]), pa.array(subs[i]), pa.array(lo), pa.array(hi)], ["doc", "sub", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            if held and row[:4] == held[-1][:4]:
                continue
            if size > BLOCK_BYTES and row[0] != held[-1][0]:
                yield solved()
                held.clear()
                size = 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solved()


def repeats(codes: list[int], places: list[int], contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, first and last window start of each run of repeated windows.

    Rows are ordered by code and then from early to late. The rows' bytes are laid out with their
    anchors at multiples of the period, so that the windows of a bucket have one remainder."""
    place = np.array(places, np.int64)
    lo, more, near = place >> 16, (place >> 8) & 255, place & 255
    code = np.array(codes, np.int64)
    bucket = np.cumsum(np.concatenate(([0], code[1:] != code[:-1])))
    sizes = np.array([len(b) for b in contents], np.int64)
    room = -(-(sizes + PERIOD - near % PERIOD + PERIOD) // PERIOD) * PERIOD
    base = np.cumsum(room) - room
    begin = base + (-near) % PERIOD  # so that begin + near is a multiple of the period
    data = np.zeros(int(room.sum()) + PERIOD, np.uint8)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    data[np.arange(len(flat)) + shift] = flat
    block = Block(data)
    rows_of, start_of = [], []
    for offset in range(SPAN):  # one bucket of suffixes for each anchor string and offset
        j = near - offset
        some = np.flatnonzero((j >= 0) & (j <= more))
        if len(some) < 2:
            continue
        order, same = block.sort(begin[some] + j[some], bucket[some], (-offset) % PERIOD)
        late = some[order[same]]
        rows_of.append(late)
        start_of.append(lo[late] + j[late])
    if not rows_of:
        none = np.zeros(0, np.int64)
        return none, none, none
    rows, start = np.concatenate(rows_of), np.concatenate(start_of)
    order = np.lexsort((start, rows))
    rows, start = rows[order], start[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows))[: len(first)] - 1
    return rows[first], start[first], start[last]


def cut_out(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """text without the windows that start at lo to hi; bytes removed; maximal removed runs."""
    if not len(lo):
        return text, 0, 0
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    starts, ends = lo[first], np.append(end[first[1:] - 1], end[-1])
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


def _ranges(few: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """doc, sub, found (array of lo, hi) of the repeats in few(doc, text); whether sub is in use."""
    ids = few.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc").limit(1).count()
    twice = bool(ids)
    rows = _rows(few, twice).repartition("code").sortWithinPartitions("code", "around", "doc", "sub", "place")
    settled = stored(rows.mapInArrow(lean(_stream), "leader boolean, code long, doc long, sub long, place long"))
    leaders = settled.where("leader").drop("leader")
    several = leaders.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = settled.where("not leader").select(
        "doc", "sub", F.shiftright("place", 16).alias("lo"), (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("hi")
    )
    parts = _windows(few.withColumn("sub", _sub() if twice else F.lit(0).cast("long")), leaders.join(several, "code"), hot)
    found = whole.unionByName(parts).groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    return found, twice


def _sub() -> F.Column:
    """What tells apart the texts of one id: 56 bits of the text's md5."""
    return F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 14), 16, 10).cast("long")


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with its rows' places in the order of ids as doc, null ids last."""
    mine = docs[f"`{id_col}`"]
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if docs.where(mine == _LAST).isEmpty():
            return docs.select(F.coalesce(mine.cast("long"), F.lit(_LAST)).alias("doc"), row)
    ids = stored(docs.select(mine.alias("id")).where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    # places count from 0 in each partition; the partitions stand in order, and their sizes are few numbers
    sizes = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    first = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))
    rank = ids.join(first, "part").select("id", (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc"))
    packed = docs.select(mine.alias("id"), row).join(rank, "id", "left")
    return packed.select(F.coalesce("doc", F.lit(_LAST)).alias("doc"), "row")


def _cut_all(rows: DataFrame, found: DataFrame, twice: bool, function, schema: T.StructType) -> DataFrame:
    """function(row values, kept bytes, removed, spans) over rows(doc, text, row) with their ranges."""
    if twice:
        both = rows.withColumn("sub", _sub()).join(found, ["doc", "sub"], "left").drop("sub")
    else:
        both = rows.join(found.drop("sub"), "doc", "left")
    both = both.select("doc", "text", "row", "found")
    names = schema.fieldNames()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found = text_bytes(batch.column(1)), batch.column(3)
        bounds = found.offsets.to_numpy()
        ok = found.is_valid().to_numpy(zero_copy_only=False)
        lo, hi = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        none = np.zeros(0, np.int64)
        done = []
        for i, t in enumerate(texts):
            a, b = (bounds[i], bounds[i + 1]) if ok[i] else (0, 0)
            done.append(cut_out(t, lo[a:b], hi[a:b]) if b > a else cut_out(t, none, none))
        return pa.RecordBatch.from_arrays([batch.column(2), *function(texts, done)], names)

    return _by_batch(both, run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    rows = _numbered(docs, "id").select("doc", F.coalesce("row.text", F.lit("")).alias("text"), F.col("row.id").alias("row"))
    found, twice = _ranges(rows.select("doc", "text"), hot)
    kind = docs.schema["id"].dataType.simpleString()

    def digest(texts, done):
        yield pa.array([len(t) for t in texts], pa.int64())
        yield pa.array([d[1] for d in done], pa.int64())
        yield pa.array([d[2] for d in done], pa.int64())
        yield pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())

    schema = T.StructType.fromDDL(f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _cut_all(rows, found, twice, digest, schema)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs with repeated passages cut out of text_col (and n_chars, where there is one, counted anew)."""
    rest = [c for c in docs.columns if c != text_col]
    rows = _numbered(docs, id_col)
    rows = rows.select("doc", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"), F.struct(*[F.col(f"row.`{c}`") for c in rest]).alias("row"))
    found, twice = _ranges(rows.select("doc", "text"), hot)

    def texts_of(texts, done):
        yield pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string())
        yield pa.array([d[1] for d in done], pa.int64())

    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType()), T.StructField("removed", T.LongType())])
    cut = _cut_all(rows, found, twice, texts_of, schema)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("kept").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return cut.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
