"""Token counts by byte-pair merging with a heap and a linked list; no token ids are produced.

A word starts as its UTF-8 bytes. The adjacent pair of lowest merge rank (leftmost on ties) is
popped from a heap and joined in a linked list until no known pair is left; the count is the initial
number of symbols less the merges made. Counts of words are kept in a bounded cache per worker.

Defined results: null text counts as empty (0 bytes, 0 tokens). Rows are independent, so repeated
rows give repeated results and columns other than id and text are ignored. Very long words cost
n log n. Special strings inside a text are one token each, as the vocabulary file's library has it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideframe.llm.common import arrow_map, table

#: Words whose counts a worker keeps; all are forgotten when the cache is full.
CACHE_WORDS = 400_000
#: Spaces by Unicode's White_Space property; str.split() takes four separators more.
_SPACE = "\\t-\\r \\x85\\p{Z}"
_ODD = regex.compile("[\\x1c-\\x1f]")


class MergeTable:
    """Counts tokens of texts under a byte-level pair-merge vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        shown = _shown_bytes()
        self.inner = [number(c) for c in shown]
        self.last = [number(c + self.end) for c in shown]
        self.known = [s in model["vocab"] for s in shown], [s + self.end in model["vocab"] for s in shown]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number(a), number(b)] = (rank, number(a + b))
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace("\\s", _SPACE))
        self.seen: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        """Tokens of one piece."""
        n = len(word)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in word[:-1]]
        symbol.append(self.last[word[-1]])
        ranks = self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(*r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((made, symbol[k])):
                    heapq.heappush(heap, (*r, i, made, symbol[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbol[h], made))):
                heapq.heappush(heap, (*r, h, symbol[h], made))
        return count

    def plain(self, text: str) -> int:
        """Tokens of text without special strings."""
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a whole-word lower() would choose the final form of sigma
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return sum(self.word(p.encode()) for p in self.pieces.findall(text))

    def chunk(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if _ODD.search(text):
            return self.chunk(text)
        seen, total = self.seen, 0
        for chunk, times in Counter(text.split()).items():
            n = seen.get(chunk)
            if n is None:
                n = self.chunk(chunk)
                if len(chunk) <= 64:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[chunk] = n
            total += n * times
        return total


def _shown_bytes() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    """The table of a file, one for each worker process."""
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    path: of the vocabulary file, the same on every executor."""
    few = df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{text_col}`"].alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = merge_table(path)
        texts = batch.column(1).to_pylist()
        tokens = [t.count(x) if x else 0 for x in texts]
        sizes = [len(x.encode()) if x else 0 for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(few, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
