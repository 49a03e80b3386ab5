"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1 drawn from a generator seeded by the letter itself.
A trigram's vector binds (multiplies) its letters' vectors, permuted (rolled) by their place. A
text's profile bundles (adds) the vectors of all its trigrams; a language's prototype bundles the
unit profiles of all its training texts. A text gets the language of the nearest prototype by cosine.

Letters are lower-cased code points; each run of anything else is one separator, which takes part
like a letter. Training reads every training row: batches emit one partial sum for each language,
which Spark adds up, so only one vector for each language reaches the driver.

Defined results: text that is null or has no letter is ``und`` with score 0; without any training
row every text is ``und``. Ties go to the language whose name sorts first. Rows with a null lang are
never learned from. Repeated rows count as often as they stand. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import by_bytes, remainder, table

DIMENSIONS = 512
SEED = 4
UNKNOWN = "und"
#: More languages than this are an error: prototypes are held by the driver and every worker.
MOST_LANGUAGES = 4_096
#: Letters whose vectors a worker keeps, and trigrams whose vectors stand in memory at once (2.5 KB each).
MOST_LETTERS, CHUNK = 32_768, 16_384

_ALPHA: np.ndarray | None = None
_LETTERS: dict[tuple[int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The letter's vector; 0 is the separator."""
    v = _LETTERS.get((code, dimensions))
    if v is None:
        if len(_LETTERS) >= MOST_LETTERS:
            _LETTERS.clear()
        rng = np.random.Generator(np.random.Philox(key=(SEED << 32) | code))
        v = _LETTERS[code, dimensions] = (rng.integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)
    return v


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each text: the sum of its trigrams' vectors; zeros if it has no letter."""
    codes, bounds = [], [0]
    alpha = _is_letter()
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(alpha[c], c, 0).astype(np.int64)
        if c.any():
            c = np.concatenate(([0], c, [0]))
            c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]
            codes.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
            bounds.append(bounds[-1] + len(codes[-1]))
        else:
            bounds.append(bounds[-1])
    out = np.zeros((len(texts), dimensions), np.float32)
    if not codes:
        return out
    keys, place = np.unique(np.concatenate(codes), return_inverse=True)
    parts = [(keys >> s) & 0x1FFFFF for s in (42, 21, 0)]
    counted = []
    for i in range(len(texts)):
        own, n = np.unique(place[bounds[i] : bounds[i + 1]], return_counts=True)
        counted.append((own, n.astype(np.float32)))
    for start in range(0, len(keys), CHUNK):
        stop = min(start + CHUNK, len(keys))
        letters = np.unique(np.concatenate([p[start:stop] for p in parts]))
        known = np.stack([letter_vector(int(x), dimensions) for x in letters])
        vectors = np.ones((stop - start, dimensions), np.int8)
        for shift, p in zip((2, 1, 0), parts):
            vectors *= np.roll(known, shift, axis=1)[np.searchsorted(letters, p[start:stop])]
        vectors = vectors.astype(np.float32)
        for i, (own, n) in enumerate(counted):
            a, b = np.searchsorted(own, (start, stop))
            if a < b:
                out[i] += n[a:b] @ vectors[own[a:b] - start]
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _grouped(texts: list[str | None]):
    """Ranges of texts small enough for one matrix, and their unit profiles."""
    plain = [t or "" for t in texts]
    for a, b in by_bytes(plain):
        yield a, b, _unit(profiles(plain[a:b]))


def learn(df: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language in df(lang, text)."""

    def partial(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, rows in _grouped(texts):
                for lang, row in zip(langs[a:b], rows):
                    if lang in sums:
                        sums[lang] += row
                    else:
                        sums[lang] = row.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "v"])

    some = df.select("lang", "text").where("lang is not null and text is not null")
    sums = some.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    found = {r.lang: np.array([x.v for x in r.v], np.float64) for r in rows}
    return {k: found[k] for k in sorted(found) if np.any(found[k])}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine to the nearest prototype, 0 to 1)."""
    few = df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{text_col}`"].alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()
    names = [*prototypes]
    known = _unit(np.stack([*prototypes.values()])).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, _, rows in _grouped(batch.column(1).to_pylist()):
                if not names:
                    langs += [UNKNOWN] * len(rows)
                    scores += [0.0] * len(rows)
                    continue
                near = rows @ known.T
                best, some = near.argmax(axis=1), np.any(rows, axis=1)
                langs += [names[k] if ok else UNKNOWN for k, ok in zip(best, some)]
                scores += np.clip(np.where(some, near.max(axis=1), 0), 0, 1).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return few.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(remainder(F.col("doc_id"), 3) != 1))
    held = remainder(F.col("doc_id"), 3) == 1
    return predict(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")
