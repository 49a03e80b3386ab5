"""Benchmark decontamination by template windows with slot checks.

Items and documents are turned into templates: outer punctuation goes, letters are lower-cased,
numbers, units of measure and names become typed placeholders whose values are kept as slots. A name
is a capitalised word that no item of the whole benchmark writes in lower case. Windows of eight
template tokens (whole items, where shorter) are hash-joined: the benchmark's windows are a sorted
hash table that every worker holds, so documents are never shuffled. Windows that agree lie on a
diagonal of item and document; there, each slot value of the item must stand for one value of the
document throughout, and two names never for the same one; windows that hold the item's own words
count in any case. An item is found in a document when such windows cover at least half of its tokens.

The benchmark is a query set: the documents are read once for each block of items, in a job of its
own that stores what it found, so workers hold one block of about ``BLOCK_WINDOWS`` windows at a time.
Findings are stored by the text's md5 and joined with the rows; blocks of any size give equal results.
The words that are no names are held as hashes; more than ``MOST_WORDS`` different ones are an error.

Defined results: null or empty text contains nothing. Items of fewer than three tokens, or without
three ordinary words, cannot be told from ordinary text: they take no part and ``skipped`` lists them.
An item_id with several texts stands for all of them; a null item_id counts in contaminated, not in
n_items or item_ids. Repeated documents are judged alike. An empty benchmark or table finds nothing.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideframe.llm.common import GROUP_BYTES, mix64, stored, table

WINDOW = 8
LEAST_TOKENS = 3
LEAST_COVER = 0.5
#: Windows of the benchmark that a worker holds at once (about 100 bytes each).
BLOCK_WINDOWS = 500_000
#: Different words that are no names (8 bytes each).
MOST_WORDS = 4_000_000
CACHE_WORDS = 400_000
#: Bits of a window hash that are looked up before the table is searched.
SIEVE_BITS = 22

UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs oz pound pounds ounce ounces ton tons tonne tonnes "
    "l ml cl liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week "
    "weeks month months year years ms hz khz mhz ghz kb mb gb tb w kw mw v kv a ma j kj kcal cal n pa kpa mph kmh percent pct % $ € £ ¥ "
    "usd eur gbp dollar dollars cent cents euro euros degree degrees meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters gram grams kilogram kilograms kilo kilos".split()
)
NUMBER, UNIT, NAME = "\x00num", "\x00unit", "\x00name"
_EDGE = re.compile(r"^[^\w$€£¥%+-]+|[^\w$€£¥%]+$")
_NUMBER = re.compile(r"[+-]?[$€£¥]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-z]{1,3})?")


class Written:
    """The words that are no names, as sorted hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = array("Q", np.sort(np.asarray(hashes, np.uint64)).tobytes())

    @classmethod
    def of(cls, words) -> Written:
        return cls(np.array([_word_hash(w) for w in words], np.uint64))

    def __contains__(self, word: str) -> bool:
        h = _word_hash(word)
        at = bisect_left(self.hashes, h)
        return at < len(self.hashes) and self.hashes[at] == h


def plain_words(text: str | None) -> set[str]:
    """The text's words that stand in lower case, without outer punctuation."""
    return {x for w in (text or "").split() if (x := _EDGE.sub("", w)) and x == x.lower()}


def canonical(word: str, written: Written) -> str:
    """The word's template token; empty for mere punctuation."""
    w = _EDGE.sub("", word)
    low = w.lower()
    if not w:
        return ""
    if low in UNITS:
        return UNIT
    if _NUMBER.fullmatch(low):
        return NUMBER
    if not any(map(str.isalnum, w)):
        return ""
    if w[0].isupper() and low != w and w[1:] == low[1:] and low not in written:
        return NAME
    return low


def template(text: str | None, written) -> tuple[list[str], list[str]]:
    """Template tokens and the words that they stand for."""
    tokens, words = [], []
    for w in (text or "").split():
        if c := canonical(w, written):
            tokens.append(c)
            words.append(_EDGE.sub("", w).lower())
    return tokens, words


_PLACE = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _word_hash(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size token hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out += h[k : k + n] * _PLACE[k]
    return mix64(out)


class _Hashes(dict):
    """The hash of each word's template token; 0 marks mere punctuation."""

    def __init__(self, written: Written) -> None:
        super().__init__()
        self.written = written

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        c = canonical(word, self.written)
        h = self[word] = _word_hash(c) or 1 if c else 0
        return h


@dataclass
class Index:
    """The templates of a block of items and their windows, sorted by hash."""

    items: list
    written: Written
    tokens: list[list[str]] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[object, str]], written: Written) -> Index:
        index = Index([], written)
        found = defaultdict(list)
        for item, text in items:
            tokens, words = template(text, written)
            if not tellable(tokens):
                continue
            size = min(WINDOW, len(tokens))
            h = window_hashes(np.array([_word_hash(t) or 1 for t in tokens], np.uint64), size)
            found[size] += [(int(x), len(index.items), k) for k, x in enumerate(h)]
            index.items.append(item)
            index.tokens.append(tokens)
            index.words.append(words)
        for size, rows in found.items():
            rows.sort()
            index.tables[size] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        return index

    def __post_init__(self) -> None:
        self._known = _Hashes(self.written)
        self._sieves: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _sieve(self, size: int) -> np.ndarray:
        if size not in self._sieves:
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(self.tables[size][0] >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self._sieves[size] = sieve
        return self._sieves[size]

    def hits(self, texts: list[str]) -> dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]]:
        """For each text that shares windows with items: which of its words are tokens, and place and table row of the
        windows, by window size."""
        known, kept, parts, owner = self._known, [], [], []
        for i, t in enumerate(texts):
            h = np.fromiter(map(known.__getitem__, t.split()), np.uint64)
            kept.append(np.flatnonzero(h))
            parts.append(h[kept[-1]])
            owner.append(np.full(len(kept[-1]), i))
        out: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        if not parts:
            return out
        tokens, owner = np.concatenate(parts), np.concatenate(owner)
        first = np.searchsorted(owner, np.arange(len(texts)))
        for size, (hashes, _, _) in self.tables.items():
            own = window_hashes(tokens, size)
            at = np.flatnonzero(self._sieve(size)[(own >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + size - 1]]
            low, high = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], "right")
            some = low < high
            for p, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
                i = int(owner[p])
                here = out.setdefault(i, (kept[i], defaultdict(list)))[1][size]
                here += [(p - int(first[i]), row) for row in range(a, b)]
        return out

    def found(self, texts: list[str | None]) -> list[list[int]]:
        """Places in items of what each text holds to LEAST_COVER at least."""
        out: list[list[int]] = [[] for _ in texts]
        start, size = 0, 0
        for stop in range(len(texts) + 1):
            if stop == len(texts) or size > GROUP_BYTES:
                for i, shared in self.hits([t or "" for t in texts[start:stop]]).items() if self.tables else ():
                    out[start + i] = self._held(texts[start + i], shared)
                start, size = stop, 0
            if stop < len(texts):
                size += len(texts[stop] or "")
        return out

    def found_in(self, text: str | None) -> list:
        return sorted({self.items[i] for i in self.found([text])[0]})

    def _held(self, text: str, shared: tuple[np.ndarray, dict[int, list[tuple[int, int]]]]) -> list[int]:
        kept, by_size = shared
        diagonals: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for size, places in by_size.items():
            _, items, at = self.tables[size]
            for p, row in places:
                diagonals[int(items[row])][p - int(at[row])].append(int(at[row]))
        raw: list[str] = []
        words: dict[int, str] = {}
        out = []
        for i, shifts in diagonals.items():
            mine, own, size = self.tokens[i], self.words[i], min(WINDOW, len(self.tokens[i]))
            if len({k for places in shifts.values() for p in places for k in range(p, p + size)}) < LEAST_COVER * len(mine):
                continue
            raw = raw or text.split()
            covered: set[int] = set()
            for shift, places in shifts.items():
                ok = {}
                for k in {k for p in places for k in range(p, p + size)}:
                    w = raw[kept[k + shift]]
                    words[k + shift] = _EDGE.sub("", w).lower()
                    ok[k] = canonical(w, self.written) == mine[k]
                places = [p for p in places if all(ok[k] for k in range(p, p + size))]
                held = sorted({k for p in places for k in range(p, p + size)})
                if not self._consistent(i, shift, held, words):
                    held = {k for p in places if all(words[k + shift] == own[k] for k in range(p, p + size)) for k in range(p, p + size)}
                covered.update(held)
            if len(covered) >= LEAST_COVER * len(mine):
                out.append(i)
        return sorted(out)

    def _consistent(self, i: int, shift: int, held: list[int], words: dict[int, str]) -> bool:
        """Whether each slot value of the item stands for one value of the document."""
        stands: dict[tuple[str, str], str] = {}
        names: dict[str, str] = {}
        for k in held:
            kind = self.tokens[i][k]
            if kind[0] == "\x00":
                mine, other = self.words[i][k], words[k + shift]
                if stands.setdefault((kind, mine), other) != other or kind == NAME and names.setdefault(other, mine) != mine:
                    return False
        return True


def tellable(tokens: list[str]) -> bool:
    """Whether an item of these tokens can be told from ordinary text."""
    return len(tokens) >= LEAST_TOKENS and sum(t[0] != "\x00" for t in tokens) >= LEAST_TOKENS


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where("text is not null").distinct()


def _written(items: DataFrame) -> Written:
    """The words that any item writes in lower case."""

    def words(batches):
        for batch in batches:
            found = {_word_hash(w) for t in batch.column(0).to_pylist() for w in plain_words(t)}
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).view(np.int64))], ["h"])

    hashes = items.select("text").mapInArrow(words, "h long").distinct().limit(MOST_WORDS + 1).toPandas()["h"].to_numpy(np.int64)
    if len(hashes) > MOST_WORDS:
        raise ValueError(f"the benchmark writes more than {MOST_WORDS} different words")
    return Written(hashes.view(np.uint64))


def skipped(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the items that take no part, because they cannot be told from ordinary text."""
    items = _items(benchmark)
    written = _written(items)

    def few(batches):
        for batch in batches:
            yield batch.filter(pa.array([not tellable(template(t, written)[0]) for t in batch.column(1).to_pylist()], pa.bool_()))

    return items.mapInArrow(few, items.schema)


def _key(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _findings(texts: DataFrame, benchmark: DataFrame, block_windows: int) -> DataFrame:
    """key, item_id of what the texts(text) hold: one stored table for each block of items."""
    items = _items(benchmark)
    kind = items.schema["item_id"].dataType.simpleString()
    arrow = to_arrow_type(items.schema["item_id"].dataType)
    windows = items.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = max(1, -(-int(windows) // block_windows))
    written = _written(items)
    keyed = texts.select("text", _key(F.col("text")).alias("key"))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        index = Index.of(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[1], str(r[0]))), written)

        def run(batches, index=index, arrow=arrow):
            for batch in batches:
                found = index.found(batch.column(0).to_pylist())
                rows = sorted({(k, i) for k, here in zip(batch.column(1).to_pylist(), found) for i in here})
                held = [index.items[i] for _, i in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array(held, arrow)], ["key", "item_id"])

        parts.append(stored(keyed.mapInArrow(run, f"key binary, item_id {kind}")))
    return reduce(DataFrame.unionByName, parts)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (ascending)."""
    few = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    found = _findings(few, benchmark, block_windows).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = few.select("doc_id", _key(F.col("text")).alias("key")).join(found, "key", "left")
    ids = F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType))
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    text = docs[f"`{text_col}`"]
    found = _findings(docs.select(text.alias("text")), benchmark, block_windows).select("key").distinct()
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _key(text).alias("key"))
    return packed.join(found, "key", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
