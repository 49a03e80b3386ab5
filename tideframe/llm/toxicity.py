"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Training windows of labelled texts are gathered by class; each class's dictionary is filled with the
windows that tell it from the other class, the most telling last (nearest, so cheapest to refer to).
Both dictionaries also hold the same common text, so that a window's two compressed lengths differ
only by what its class adds. A window is a word of at most 64 bytes between spaces, compressed
behind a fixed carrier that both dictionaries hold: without it so short an input would be stored
raw. The length difference, by window length, has a calibrated evidence value (log likelihood ratio
in toxic and ordinary texts that the dictionaries at hand did not see); a text's summed evidence and its length go
through a fitted logistic curve.

Dictionaries and calibration use a bounded sample: at most ``SAMPLE`` labelled texts and
``SAMPLE_BYTES`` bytes of each class, taken in the order of a hash of doc_id. Scoring covers every
whole text.

Defined results: null or blank text has no windows and gets the curve's value at zero evidence; when
the sample lacks a class every score is the sample's share of toxic texts (0 without labels). Labels
that repeat a doc_id count once (toxic if any row says so); null labels are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import arrow_map, remainder, table

SAMPLE = 5_000
SAMPLE_BYTES = 12 << 20
WINDOW = 64
COMMON_BYTES = 32_768
CLASS_BYTES = 16_384
#: A window enters the toxic dictionary from this likelihood gain on.
LEAST_GAIN = 6.0
#: Evidence of at least this size counts as strong.
STRONG = 1.0
CACHE_WINDOWS = 300_000
#: Bytes that no text window starts with.
CARRIER = bytes(b for b in range(1, 32) if b not in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
_EDGE = '.,;:!?"()[]{}#*$%&|<>¡¿…'
LOW, HIGH, LONGEST = -3, 8, 15


def windows(text: str) -> list[str]:
    """The text's windows: lower-case words without outer punctuation, long ones cut in pieces."""
    out = []
    for w in text.lower().split():
        if w := w.strip(_EDGE):
            if len(w) <= WINDOW // 4 or len(w.encode()) <= WINDOW:
                out.append(w)
            else:
                out += [w[i : i + WINDOW // 4] for i in range(0, len(w), WINDOW // 4)]
    return out


def _filled(found: list[str], size: int) -> bytes:
    """The first windows that fit, the first of them last."""
    parts, n = [], 0
    for w in found:
        b = f" {w} ".encode()
        if n + len(b) > size:
            break
        parts.append(b)
        n += len(b)
    return b"".join(reversed(parts))


@dataclass
class Model:
    """Two dictionaries, the evidence of (window length, length difference) and the logistic curve."""

    toxic: bytes
    ordinary: bytes
    evidence: np.ndarray | None
    curve: np.ndarray
    prior: float

    def __post_init__(self) -> None:
        self._seen: dict[str, tuple[int, int]] = {}
        self._by: tuple | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def cell(self, window: str) -> tuple[int, int]:
        """Window length and how many bytes longer it is under the ordinary dictionary, as table indices."""
        found = self._seen.get(window)
        if found is None:
            if self._by is None:
                self._by = _compressor(self.ordinary), _compressor(self.toxic)
            ordinary, toxic = self._by
            b = CARRIER + f" {window} ".encode()
            gain = len(ordinary.compress(b)) - len(toxic.compress(b))
            found = min(len(b) - len(CARRIER) - 2, LONGEST), min(max(gain, LOW), HIGH) - LOW
            if len(self._seen) >= CACHE_WINDOWS:
                self._seen.clear()
            self._seen[window] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """1, strong evidence, weak evidence, the most telling window, log of the window count."""
        e, cell = self.evidence, self.cell
        strong = weak = most = 0.0
        n = 0
        for w, k in Counter(windows(text or "")).items():
            n += k
            x = float(e[cell(w)])
            if x >= STRONG:
                strong += k * x
            else:
                weak += k * x
            most = max(most, x)
        return [1.0, np.log1p(strong), weak / (n + 1), most, strong / (n + 20) * 20, np.log1p(n)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.evidence is None:
            return np.full(len(texts), self.prior)
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content += CARRIER
    how = zstandard.ZstdCompressionParameters.from_level(
        19, source_size=64, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def _dictionaries(found: list[set[str]], toxic: list[int], prior: float) -> Model:
    """A model without evidence whose dictionaries hold what tells the classes apart in these texts."""
    count, total = {0: Counter(), 1: Counter()}, Counter(toxic)
    for ws, y in zip(found, toxic):
        count[y].update(ws)

    def gain(a: int, b: int) -> float:
        return a * np.log((a + 0.5) / (total[1] * (a + b) / (total[0] + total[1]) + 0.5))

    both = ((a, count[0].get(w, 0), w) for w, a in count[1].items() if a >= 2)
    telling = sorted(((gain(a, b), w) for a, b, w in both if a * total[0] > 4 * (b + 0.3) * total[1]), reverse=True)
    plain = [w for _, w in sorted(((n, w) for w, n in count[0].items() if n * total[1] >= 0.8 * count[1].get(w, 0) * total[0]), reverse=True)]
    own = _filled([w for g, w in telling if g >= LEAST_GAIN], CLASS_BYTES)
    common = _filled(plain, COMMON_BYTES)
    other = _filled(plain[common.count(b"  ") + 1 :], len(own))
    return Model(common + own, common + other, None, np.zeros(6), prior)


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of labelled texts.

    Evidence and curve come from two half models, each measured on the texts that its dictionaries
    did not see; the final dictionaries hold all texts' windows."""
    prior = float(np.mean(toxic)) if toxic else 0.0
    if len(set(toxic)) < 2 or min(Counter(toxic).values()) < 4:
        return Model(b"", b"", None, np.zeros(6), prior)
    turn, side = {0: 0, 1: 0}, []
    for y in toxic:  # both halves get both classes
        side.append(turn[y] % 2)
        turn[y] += 1
    pool: dict[str, str] = {}  # one object for equal windows: the driver holds each spelling once
    found = [{pool.setdefault(w, w) for w in windows(t or "")} for t in texts]
    halves = [_dictionaries([f for f, s in zip(found, side) if s == h], [y for y, s in zip(toxic, side) if s == h], prior) for h in (0, 1)]
    seen = {y: np.zeros((LONGEST + 1, HIGH - LOW + 1)) for y in (0, 1)}
    for t, y, s in zip(texts, toxic, side):
        for cell, n in Counter(map(halves[1 - s].cell, windows(t or ""))).items():
            seen[y][cell] += min(n, 4)
    ratio = max(seen[1].sum(), 1) / max(seen[0].sum(), 1)
    share = 4 / (1 + ratio)
    evidence = np.log((seen[1] + share * ratio) / (seen[0] + share) / ratio)
    for half in halves:
        half.evidence = evidence

    x = np.array([halves[1 - s].features(t) for t, s in zip(texts, side)])
    halves.clear()
    y = np.array(toxic, float)
    curve = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.5] * (x.shape[1] - 1))
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ curve)
        curve = curve + step
        if np.abs(step).max() < 1e-8:
            break
    model = _dictionaries(found, toxic, prior)
    model.evidence, model.curve = evidence, curve
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str | None], list[int]]:
    """Texts and labels, at most SAMPLE of each class and SAMPLE_BYTES of text, by a hash of doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    known = known.withColumn("_order", F.xxhash64("doc_id"))
    few = [known.where(F.col("_toxic") == y).orderBy("_order", "doc_id").limit(SAMPLE) for y in (0, 1)]
    ids = F.broadcast(few[0].unionByName(few[1]).withColumnRenamed("doc_id", "_id"))
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"))
    sizes = joined.groupBy("doc_id", "_toxic", "_order").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).collect()
    left, chosen = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(sizes, key=lambda r: (r._order, r.doc_id)):
        if r.n <= left[r._toxic]:
            left[r._toxic] -= r.n
            chosen.append((r.doc_id,))
    if not chosen:
        return [], []
    spark = docs.sparkSession
    pick = F.broadcast(spark.createDataFrame(chosen, f"_pick {docs.schema['doc_id'].dataType.simpleString()}"))
    rows = joined.join(pick, F.col("doc_id") == F.col("_pick")).groupBy("doc_id", "_toxic", "_order").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (r._order, r.doc_id))
    return [r.text for r in rows], [r._toxic for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted."""
    few = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(few, run, f"doc_id {kind}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = remainder(F.col("doc_id"), 5) != 0
    model = fit(*sample(docs.where(learnable), table(spark, sf_dir, "labels").where(learnable)))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
