"""Language-model scoring with a probabilistic suffix tree over bytes.

Texts are lower-cased (A-Z), their words joined by single spaces and ended by one line feed. The
tree's contexts are runs of up to ``DEPTH`` bytes. Counts come from every training text: tasks count
runs of DEPTH + 1 bytes, Spark adds them up, and shorter runs are sums of longer ones. Level by
level, a context is retained if it was seen ``LEAST_COUNT`` times and its next-byte distribution
diverges from that of its longest retained suffix: the log likelihood gained by it is at least
``LEAST_GAIN``. Both bounds are absolute, so the tree grows with the corpus, and nothing else limits
it. A retained context's distribution is smoothed with its longest retained suffix's, down to the
uniform one. Each byte is scored by the longest retained context that ends before it.

The tree is a set of stored tables. Workers hold its most frequent contexts, ``HELD_ENTRIES``
probabilities at most, and a bit map of the other contexts, ``REST_BITS`` long. A place in a text
whose context may be one of the others is handed on as a row and resolved by joins with the tables,
so scores do not depend on what workers hold. The base score is the add-one unigram over words:
counts of all training words stay distributed; the most frequent words are looked up in the tasks,
the rest are joined, so a word that is joined makes up less than 1 / FREQUENT_WORDS of all.

Defined results: null text counts as empty and consists of its end token. Texts with equal bytes
have equal scores up to rounding, so repeated rows and ids do no harm. Without training texts N and
V are 0, every base score is 0 and the tree is the uniform distribution. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tideframe.llm.common import by_bytes, discard, lean, mix64, remainder, stored, table, text_bytes

DEPTH = 5
LEAST_COUNT = 2
LEAST_GAIN = 3.0
#: Weight of the shorter context's distribution in a context's, in counts.
PRIOR = 4.0
#: Probabilities that a worker holds (12 bytes each), and bits of the map of other contexts.
HELD_ENTRIES = 2_000_000
REST_BITS = 25
#: Words that are looked up in each task; the others are joined.
FREQUENT_WORDS = 65_536
#: Distinct runs that a task holds before it hands them on.
HELD_RUNS = 1_000_000
#: Bytes whose runs are looked at at once: numpy's temporaries take up to a hundred times as much.
PIECE = 1 << 18
END = 10
_MASK = [(1 << (8 * (k + 1))) - 1 for k in range(DEPTH + 1)]


def symbols(text: bytes) -> bytes:
    """The text as the tree reads it: single spaces, a line feed at the end, A-Z lower-cased."""
    return b" ".join(text.lower().split()) + b"\n"


def _codes(parts: list[bytes]) -> np.ndarray:
    """The code of each byte of the parts with the DEPTH bytes before it; a part's first DEPTH bytes have none."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    code = data[: len(data) - DEPTH].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        code <<= np.uint64(8)
        code |= data[k : k + len(code)]
    inside = np.ones(len(data), bool)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    for k in range(DEPTH):
        inside[starts + k] = False
    return code[inside[DEPTH:]]


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The code of each byte of the texts with the DEPTH bytes before it, and the number of its text, in pieces of
    about ``PIECE`` bytes at most, whatever a text's length; line feeds stand before a text."""
    lead = bytes([END]) * DEPTH
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0

    def piece():
        return _codes(parts), np.repeat(owner, [len(p) - DEPTH for p in parts])

    for i, t in enumerate(texts):
        t = lead + symbols(t)
        for a in range(0, len(t) - DEPTH, PIECE):
            part = t[a : a + PIECE + DEPTH]
            if size and size + len(part) > PIECE:
                yield piece()
                parts, owner, size = [], [], 0
            parts.append(part)
            owner.append(i)
            size += len(part)
    if parts:
        yield piece()


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of each one's counts."""
    codes, n = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


def count_runs(docs: DataFrame) -> DataFrame:
    """run, n over all docs(text): codes of DEPTH + 1 bytes."""

    def count(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, more = none, []

        def rows(codes, n):
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["run", "n"])

        for batch in batches:
            for codes, _ in _runs(text_bytes(batch.column(0))):
                more.append(np.unique(codes, return_counts=True))
                if sum(len(x) for x, _ in more) > HELD_RUNS // 2:
                    held, more = _summed([held, *more]), []
                    if len(held[0]) > HELD_RUNS:
                        yield from rows(*held)
                        held = none
        yield from rows(*_summed([held, *more]))

    return docs.select("text").mapInArrow(lean(count), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def levels(runs: DataFrame) -> list[DataFrame]:
    """For each context length the stored rows run, context, n, m, back, log: counts of run and context, log10 of the weight
    that a retained context leaves to the shorter ones (null: not retained), and log10 of the run's probability."""
    runs = stored(runs)
    out: list[DataFrame] = []
    for k in range(DEPTH + 1):
        grams = runs if k == DEPTH else runs.groupBy(F.col("run").bitwiseAND(F.lit(_MASK[k])).alias("run")).agg(F.sum("n").alias("n"))
        of = Window.partitionBy("context")  # 256 rows at most
        grams = grams.withColumn("context", F.shiftrightunsigned("run", 8)).withColumn("m", F.sum("n").over(of))
        if k:
            shorter = out[-1].select(F.col("run").alias("suffix"), F.col("log").alias("base"))
            grams = grams.withColumn("suffix", F.col("run").bitwiseAND(F.lit(_MASK[k - 1]))).join(shorter, "suffix")
            gain = F.sum(F.col("n") * (F.log(F.col("n") / F.col("m")) - F.col("base") * float(np.log(10)))).over(of)
            kept = (F.col("m") >= LEAST_COUNT) & (gain >= LEAST_GAIN)
        else:
            grams, kept = grams.withColumn("base", F.lit(-float(np.log10(256)))), F.lit(True)
        grams = grams.withColumn("kept", kept)
        log = F.when(F.col("kept"), F.log10((F.col("n") + PRIOR * F.pow(F.lit(10.0), "base")) / (F.col("m") + PRIOR))).otherwise(F.col("base"))
        back = F.when(F.col("kept"), F.log10(PRIOR / (F.col("m") + PRIOR)))
        out.append(stored(grams.select("run", "context", "n", "m", back.alias("back"), log.alias("log"))))
    discard(runs)
    return out


def _places(key: np.ndarray) -> np.ndarray:
    return (mix64(key.copy()) >> np.uint64(64 - REST_BITS)).astype(np.int64)


@dataclass
class Tree:
    """The held part of the tree: sorted contexts and runs, keyed by length and bytes, and the map of the other contexts."""

    contexts: np.ndarray
    back: np.ndarray
    runs: np.ndarray
    log: np.ndarray
    rest: np.ndarray | None

    def _others(self, context: np.ndarray) -> np.ndarray:
        """Which contexts the map of the others has; it stays packed."""
        place = _places(context)
        return (self.rest[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).view(bool)

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the last byte of each code of DEPTH + 1 bytes, and which codes are not decided here."""
        out, open_ = np.zeros(len(codes)), np.zeros(len(codes), bool)
        at, fresh = np.arange(len(codes)), np.ones(len(codes), bool)
        for k in range(DEPTH, -1, -1):
            run = codes[at] & np.uint64(_MASK[k])
            length = np.uint64(k << 48)
            context = length | (run >> np.uint64(8))
            place = np.minimum(np.searchsorted(self.contexts, context), max(len(self.contexts) - 1, 0))
            hit = self.contexts[place] == context if len(self.contexts) else np.zeros(len(at), bool)
            go_on = np.ones(len(at), bool)
            if self.rest is not None and k:
                doubt = np.flatnonzero(~hit & fresh[at])
                doubt = doubt[self._others(context[doubt])]
                open_[at[doubt]] = True
                go_on[doubt] = False
            some = np.flatnonzero(hit)
            if len(some):
                fresh[at[some]] = False
                key = length | run[some]
                where = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
                seen = self.runs[where] == key
                out[at[some[seen]]] += self.log[where[seen]]
                out[at[some[~seen]]] += self.back[place[some[~seen]]]
                go_on[some[seen]] = False
            at = at[go_on]
        out[at] -= np.log10(256)
        return out, open_

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text as far as it is decided here; where each text's undecided codes start (and the last
        ones end), and these codes and their counts."""
        total = np.zeros(len(texts))
        left = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for codes, owner in _runs(texts):
            codes, place = np.unique(codes, return_inverse=True)
            log, open_ = self.lookup(codes)
            log[open_] = 0
            total += np.bincount(owner, log[place], len(texts))
            some = open_[place]
            if some.any():
                pairs, n = np.unique(owner[some] * len(codes) + place[some], return_counts=True)
                left.append((pairs // len(codes), codes[pairs % len(codes)], n))
        owner, codes, n = (np.concatenate(x) for x in zip(*left))
        return total, np.searchsorted(owner, np.arange(len(texts) + 1)), codes, n


def held_part(tables: list[DataFrame], limit: int) -> tuple[Tree, int]:
    """What workers hold of the tree, and the least count of a context in it: the least power of two with which it fits."""
    sizes = [t.where("back is not null").groupBy(F.floor(F.log2("m")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect() for t in tables[1:]]
    of = Counter()
    for rows in sizes:
        of.update({r.power: r.n for r in rows})
    least, total = 1, sum(of.values())
    for power in sorted(of):
        if total <= limit:
            break
        total -= of[power]
        least = 1 << (power + 1)
    contexts, back, runs, log = [], [], [], []
    for k, t in enumerate(tables):
        code, of, value = _packed(t.where("back is not null" + (f" and m >= {least}" if k else "")).select("run", "back", "log"))
        order = np.argsort(code)
        code = code[order] | np.uint64(k << 48)
        context = (code & np.uint64(_MASK[DEPTH])) >> np.uint64(8) | np.uint64(k << 48)
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        runs.append(code), log.append(value[order])
        contexts.append(context[new]), back.append(of[order][new])
    rest = None
    if least > 1:
        rest = np.zeros(1 << (REST_BITS - 3), np.uint8)
        for k, t in enumerate(tables[1:], 1):
            rest |= _rest_map(t.where(f"back is not null and m < {least}").select("context"), k)
    return Tree(*(np.concatenate(x) for x in (contexts, back, runs, log)), rest), least


def _packed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of rows(run, back, log) on the driver, sent as packed numbers: 16 bytes a row there, without a frame of rows."""

    def pack(batches):
        for batch in batches:
            code, back, log = (batch.column(k).to_numpy() for k in range(3))
            parts = [code.tobytes(), back.astype(np.float32).tobytes(), log.astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["run", "back", "log"])

    found = rows.mapInArrow(pack, "run binary, back binary, log binary").collect()
    return tuple(np.frombuffer(b"".join(r[k] for r in found), t) for k, t in enumerate((np.uint64, np.float32, np.float32)))


def _rest_map(contexts: DataFrame, k: int) -> np.ndarray:
    """The packed map of contexts(context) of length k; tasks send the 64-bit words that they set."""

    def mark(batches):
        mine = np.zeros(1 << REST_BITS, bool)
        for batch in batches:
            mine[_places(batch.column(0).to_numpy().view(np.uint64) | np.uint64(k << 48))] = True
        words = np.packbits(mine).view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], ["place", "bits"])

    rows = contexts.mapInArrow(lean(mark), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (REST_BITS - 6), np.int64)
    out[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def resolved(codes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """code, log of each of codes(code): its probability by the longest retained context of the whole tree."""
    out = codes.withColumns({"log": F.lit(0.0), "found": F.lit(False)})
    for k in range(DEPTH, -1, -1):
        # a run that was seen behind a context has its probability in the context's level, retained or not
        seen = tables[k].select(F.col("run").alias("r"), F.col("log").alias("own"))
        left = tables[k].where("back is not null").select(F.col("context").alias("c"), "back").distinct()
        out = out.withColumns({"r": F.col("code").bitwiseAND(F.lit(_MASK[k])), "c": F.shiftrightunsigned(F.col("code").bitwiseAND(F.lit(_MASK[k])), 8)})
        out = out.join(seen, "r", "left").join(left, "c", "left")
        more = F.when(F.col("found"), 0.0).when(F.col("own").isNotNull(), F.col("own")).otherwise(F.coalesce("back", F.lit(0.0)))
        out = out.select("code", (F.col("log") + more).alias("log"), (F.col("found") | F.col("own").isNotNull()).alias("found"))
    return out.select("code", F.when(F.col("found"), F.col("log")).otherwise(F.col("log") - float(np.log10(256))).alias("log"))


def _strings(words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def _lists(starts, **columns: pa.Array) -> pa.Array:
    """A list of structs for each row, null where empty; row k has what stands at starts[k]:starts[k + 1]."""
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values, mask=pa.array(np.diff(starts) == 0))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over all docs(text)."""

    def count(batches):
        for batch in batches:
            n: Counter[bytes] = Counter()
            for t in text_bytes(batch.column(0)):
                n.update(t.lower().split())
            yield pa.RecordBatch.from_arrays([_strings(n), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_ENTRIES) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    few = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    kind, arrow = few.schema["doc_id"].dataType.simpleString(), to_arrow_type(few.schema["doc_id"].dataType)
    learned = training.select(training[f"`{text_col}`"].alias("text"))
    vocabulary = stored(count_words(learned))
    size, running = vocabulary.agg(F.count(F.lit(1)), F.sum("c")).first()
    ends = learned.count()
    n_all, v_all = int(running or 0) + ends, int(size) + (ends > 0)
    most = vocabulary.orderBy(F.desc("c"), "word").limit(FREQUENT_WORDS).toPandas()
    logs = {w.encode(): float(np.log10(c + 1)) for w, c in zip(most["word"], most["c"].tolist())}
    end = float(np.log10(ends + 1))
    tables = levels(count_runs(learned))
    tree, least = held_part(tables, held)
    rare_kind, open_kind = "array<struct<word:string,n:bigint>>", "array<struct<code:bigint,n:bigint>>"
    # a worker loads a broadcast once; what a function holds is loaded for each task, beside its pickled form
    shared = docs.sparkSession.sparkContext.broadcast((tree, logs))
    del tree, logs

    def read(batches):
        tree, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            all_texts = text_bytes(batch.column(1))
            for a, b in by_bytes(all_texts):
                texts = all_texts[a:b]
                total, known, part, starts = [], [], [], [0]
                rare, rare_n = [], []
                for t in texts:
                    words = t.lower().split()
                    near = [x for x in map(logs.get, words) if x is not None]
                    total.append(len(words) + 1)
                    known.append(len(near) + (ends > 0))
                    part.append(float(sum(near)) + end)
                    if len(near) < len(words):
                        others = Counter(w for w in words if w not in logs)
                        rare += others
                        rare_n += others.values()
                    starts.append(len(rare))
                scores, open_starts, codes, n = tree.scores(texts)
                arrays = [batch.column(0).slice(a, b - a).cast(arrow), pa.array(np.arange(row, row + len(texts))), pa.array(total, pa.int64()), pa.array(known, pa.int64()), pa.array(part), pa.array(scores)]
                arrays += [_lists(starts, word=_strings(rare), n=pa.array(rare_n, pa.int64())), _lists(open_starts, code=pa.array(codes.view(np.int64)), n=pa.array(n))]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_tokens", "known", "part", "score", "rare", "open"])

    # written once, so that a row's number is the same for all that reads it
    rows = stored(few.mapInArrow(lean(read), f"doc_id {kind}, row long, n_tokens long, known long, part double, score double, rare {rare_kind}, open {open_kind}"))
    shared.destroy()
    rare = rows.where("rare is not null").select("row", F.inline("rare")).join(vocabulary, "word")
    more = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rest"))
    out = rows.drop("rare", "open").join(more, "row", "left")
    if least > 1:
        open_ = rows.where("open is not null").select("row", F.inline("open"))
        known = resolved(open_.select("code").distinct(), tables)
        found = open_.join(known, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("found"))
        out = out.join(found, "row", "left").withColumn("score", F.col("score") + F.coalesce("found", F.lit(0.0)))
    unit = float(np.log10(n_all + v_all + 1))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, docs.where(remainder(F.col("doc_id"), 7) != 2))
    held = remainder(F.col("doc_id"), 7) == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
