"""Quality by Bradley-Terry ranking: scores whose differences predict which text of a labelled pair is the better one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, release

#: Labelled documents at most that the ranking is fitted on; by hash of the id, so the choice doesn't depend on row order.
SAMPLE = 8_000
#: Opponents of each text of the rarer label.
OPPONENTS = 16
#: Score of a text that stands at the quantile that divides the labels.
THRESHOLD = 0.3
#: Slots that words and runs of three bytes are hashed to, each kind to one half.
SLOTS = 1 << 16
#: Weight of the squared weights in the loss, steps of the fit at most, and where it ends.
RIDGE, STEPS, FLAT = 1e-4, 300, 1e-6
#: Bytes of text whose features are held at once.
BLOCK = 1 << 20


def shape(text: bytes) -> list[float]:
    """Measures of the whole text: its length and word length, and how much of it is said once."""
    w, lines = text.split(), text.split(b"\n")
    n = len(w) + 1
    return [math.log(n), min(20.0, (len(text) + 1) / n), len(set(w)) / n, len(set(lines)) / (len(lines) + 1), float(not w)]


SHAPES = len(shape(b""))


def slots(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word (in lower case) and of each run of three bytes (as they are)."""
    words = np.fromiter((_WORDS[w] if w in _WORDS else _word(w) for w in text.lower().split()), np.int64) % (SLOTS // 2)
    raw = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    runs = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1) >> np.uint32(33 - SLOTS.bit_length() + 1)
    return words, runs.astype(np.int64) + SLOTS // 2


_WORDS: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    """A word's hash; those of short words seen before are remembered, up to a bounded number."""
    value = crc32(w)
    if len(_WORDS) < 200_000 and len(w) < 40:
        _WORDS[w] = value
    return value


class Texts:
    """Features of texts as rows of a sparse matrix: shares of words and of runs of bytes, and dense shapes."""

    def __init__(self, texts: list[bytes | None]):
        places, values, size = [], [], []
        for t in texts:
            n = 0
            for kind in slots(t or b""):
                at, count = np.unique(kind, return_counts=True)
                places.append(at)
                values.append(np.sqrt(count / max(1, len(kind))))
                n += len(at)
            size.append(n)
        self.place, self.value = (np.concatenate([np.zeros(0, k), *x]).astype(k) for x, k in ((places, np.int32), (values, np.float32)))
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        self.dense = np.array([shape(t or b"") for t in texts]).reshape(len(texts), SHAPES)

    def times(self, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The rows' products with w, whose last SHAPES are for the scaled shapes."""
        sparse = np.bincount(self.row, self.value * w[self.place], len(self.dense))
        return sparse + ((self.dense - mean) / scale) @ w[SLOTS:]

    def sums(self, c: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its c."""
        return np.concatenate((np.bincount(self.place, self.value * c[self.row], SLOTS), c @ ((self.dense - mean) / scale)))


def opponents(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the better and of the worse text of each pair: every text of the commoner label is in one at least, and
    every text of the rarer label in OPPONENTS or more."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = np.arange(max(len(good), len(bad), OPPONENTS * min(len(good), len(bad))))
    return good[k % len(good)], bad[(k + k // len(good)) % len(bad)]


def loss(w: np.ndarray, x: Texts, mean: np.ndarray, scale: np.ndarray, better: np.ndarray, worse: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the pairs' feature differences plus the ridge, and its slope. Differences of sparse rows
    needn't be formed: a row's part in the slope is the sum of its pairs' parts."""
    s = x.times(w, mean, scale)
    margin = s[better] - s[worse]
    lose = 1 / (1 + np.exp(np.clip(margin, -60, 60)))
    c = np.bincount(worse, lose, len(s)) - np.bincount(better, lose, len(s))
    return float(np.logaddexp(0, -margin).mean() + RIDGE / 2 * w @ w), x.sums(c / len(margin), mean, scale) + RIDGE * w


class Ranking:
    def __init__(self, texts: list[bytes | None], y: np.ndarray):
        """Fits weights by limited-memory quasi-Newton steps (of ten earlier slopes) on the loss, and the cut: the score
        quantile that divides as many texts as have the worse label from the others."""
        x = Texts(texts)
        self.mean, self.scale = (x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-3) if len(texts) else (np.zeros(SHAPES), np.ones(SHAPES))
        self.weights, self.cut = np.zeros(SLOTS + SHAPES), None
        if not (y == 1).any() or not (y == 0).any():
            return
        better, worse = opponents(y)
        value = lambda w: loss(w, x, self.mean, self.scale, better, worse)
        w, steps = self.weights, []
        f, g = value(w)
        for _ in range(STEPS):
            if np.abs(g).max() < FLAT:
                break
            d, held = g.copy(), []
            for s, q, r in reversed(steps):
                a = s @ d / r
                held.append(a)
                d -= a * q
            if steps:
                s, q, r = steps[-1]
                d *= r / (q @ q)
            for (s, q, r), a in zip(steps, reversed(held), strict=True):
                d += s * (a - q @ d / r)
            size, slope = 1.0, g @ d
            while (new := value(w - size * d))[0] > f - 1e-4 * size * slope and size > 1e-10:
                size /= 2
            s, q = -size * d, new[1] - g
            w, (f, g) = w + s, new
            if s @ q > 1e-14:
                steps = [*steps[-9:], (s, q, s @ q)]
            elif size <= 1e-10:
                break
        self.weights = w
        s = np.sort(x.times(w, self.mean, self.scale))
        n_bad = int((y == 0).sum())
        self.cut = float((s[n_bad - 1] + s[n_bad]) / 2)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """0 to 1; the texts above the quantile of the worse label's share get THRESHOLD or more."""
        if self.cut is None:
            return np.full(len(texts), 0.5)
        s = Texts(texts).times(self.weights, self.mean, self.scale) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int) -> tuple[list[bytes | None], np.ndarray]:
    """Texts and labels of at most SAMPLE labelled documents outside fold 0: of the labels that have a document, those whose
    ids hash lowest. Labels without id or other than 0 and 1 are left out; of a repeated id one label and one text count."""
    y = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    y = y.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"))
    chosen = materialize(y.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "y", F.col("text").cast("binary").alias("t"))).alias("r"))
    rows = one.select("doc_id", "r.y", "r.t").toArrow().sort_by("doc_id")
    release(chosen)
    return rows.column("t").to_pylist(), rows.column("y").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5) -> Ranking:
    """The ranking of the labelled documents outside fold 0. At most SAMPLE of them come to the driver, however many there
    are; of a text its words and bytes count, not how long it is."""
    return Ranking(*sample(docs, labels, doc_id, text, label, folds))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 where score reaches THRESHOLD).

    Null and empty texts are scored as empty ones, very long ones whole. A null id's fold is that of the empty text.
    Repeated rows are scored each for itself. Without labels of both kinds every score is 0.5. An empty table gives an
    empty result; other columns are left out. No row leaves its task."""
    ranking = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, folds))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (fold(F.col(f"`{doc_id}`"), folds) == 0).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))

    def parts(b: pa.RecordBatch) -> Iterator[list[bytes | None]]:
        texts, size = [], 0
        for t in b.column("text"):
            texts.append(t.as_py())
            size += len(texts[-1] or b"")
            if size > BLOCK:
                yield texts
                texts, size = [], 0
        yield texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.concatenate([ranking.value.scores(t) for t in parts(b)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, own.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
