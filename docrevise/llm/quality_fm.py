"""Quality classifier (operator 2): a factorisation machine.

Inputs of a document: hashed words (binary, scaled so that a text's words
weigh the same in sum), standardised structure statistics of the text, and
metadata (the given character count).  A second-order model adds the
interactions of all pairs of inputs, each pair's weight being the dot product
of two low-rank factors; the sum over pairs is scored in linear time as half
of (sum of factors) squared minus the sum of squares.

Training uses at most ``max_rows`` labelled rows (those with the smallest id
hash; the bound keeps the driver's arrays small and is a parameter), whose
features tasks compute; scoring reads every row in one pass without a shuffle.

Defined cases: null and empty texts have no words, statistics 0, and a score
like any other; a null character count counts as 0; rows without a label are
only scored; without any usable label every score is the prior 0.5; with one
class only, scores follow that class; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import LOWER_BYTES, col

BUCKETS = 1 << 14
RANK = 8
MAX_ROWS = 12_000
EPOCHS = 12
STATS = 14


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(text: str, w: list[bytes], meta_chars) -> list[float]:
    """Structure statistics of a whole text and its metadata."""
    b = text.encode()
    n, size = len(w), len(b)
    letters = size - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = size - len(b.translate(None, b"#*$%&|<>"))
    marks = size - len(b.translate(None, b"!?"))
    digits = size - len(b.translate(None, b"0123456789"))
    lines = [x for x in b.split(b"\n") if x.strip()]
    distinct = len(set(w))
    again = sum(map(bytes.__eq__, w, w[1:]))
    inner = size - n
    return [math.log1p(n), _share(inner, n), _share(symbols, size) ** 0.5, _share(letters, size) ** 0.5, _share(marks, size) ** 0.5,
            _share(digits, size) ** 0.5, _share(distinct, n), _share(again, n), _share(len(lines) - len(set(lines)), len(lines)),
            _share(n, len(lines)) ** 0.5, _share(b.count(b". ") + b.count(b".\n"), n), _share(b.count(b"http"), n) ** 0.5,
            float(n < 10), math.log1p(max(0, meta_chars or 0))]


class Featurizer:
    """Word buckets and statistics; remembers the buckets of frequent words."""

    def __init__(self, buckets: int = BUCKETS, cache: int = 200_000):
        self.buckets, self.limit, self.known = buckets, cache, {}

    def __call__(self, text: str | None, meta_chars) -> tuple[np.ndarray, list[float]]:
        text = text or ""
        w = text.encode().translate(LOWER_BYTES).split()
        if len(self.known) > self.limit:
            self.known = {}
        known, n = self.known, self.buckets
        out = set()
        for x in set(w):
            i = known.get(x)
            if i is None:
                i = known[x] = zlib.crc32(x) % n
            out.add(i)
        return np.array(sorted(out), np.int32), statistics(text, w, meta_chars)


@dataclass
class Model:
    """Weights over [hashed words, statistics]."""
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    buckets: int

    def inputs(self, words: np.ndarray, stats) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.asarray(stats) - self.mean) / self.std, -4, 4)
        x = np.concatenate([np.full(len(words), 1 / math.sqrt(max(1, len(words)))), z])
        return np.concatenate([words, self.buckets + np.arange(len(z))]), x

    def raw(self, idx: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        vx = self.v[idx] * x[:, None]
        s = vx.sum(axis=0)
        return self.bias + float(self.w[idx] @ x) + 0.5 * float(s @ s - (vx * vx).sum()), vx, s

    def score(self, words: np.ndarray, stats) -> float:
        y = self.raw(*self.inputs(words, stats))[0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, y))))


def fit(rows: list[tuple[np.ndarray, list[float], int]], buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS,
        rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adagrad on the log loss, one document at a time, in a seeded order."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[1] for r in rows]).reshape(len(rows), STATS)
    mean = stats.mean(axis=0) if len(rows) else np.zeros(STATS)
    std = np.maximum(stats.std(axis=0), 1e-3) if len(rows) else np.ones(STATS)
    d = buckets + STATS
    m = Model(0.0, np.zeros(d), rng.normal(0, 0.01, (d, rank)), mean, std, buckets)
    if not rows:
        m.v[:] = 0
        return m
    pos = sum(r[2] for r in rows)
    m.bias = math.log((pos + 1) / (len(rows) - pos + 1))
    gw, gv, gb = np.full(d, 1e-2), np.full((d, rank), 1e-2), 1e-2
    data = [(*m.inputs(r[0], r[1]), r[2]) for r in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            idx, x, y = data[i]
            raw, vx, s = m.raw(idx, x)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))) - y
            if abs(g) < 1e-3:
                continue
            dw = g * x + decay * m.w[idx]
            dv = g * (x[:, None] * (s - vx)) + decay * m.v[idx]
            gw[idx] += dw * dw
            gv[idx] += dv * dv
            gb += g * g
            m.w[idx] -= rate * dw / np.sqrt(gw[idx])
            m.v[idx] -= rate * dv / np.sqrt(gv[idx])
            m.bias -= rate * g / math.sqrt(gb)
    return m


def held_out(id_col: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, rank: int = RANK,
          epochs: int = EPOCHS) -> Model:
    """``docs``: doc_id, text, n_chars; ``labels``: doc_id, quality."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the documented bound
    # small side: at most max_rows narrow rows
    src = docs.join(F.broadcast(y), "doc_id").select("doc_id", "text", "n_chars", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feat = Featurizer(buckets)
        for b in batches:
            got = [feat(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([g[0].tobytes() for g in got], pa.binary()),
                                              pa.array([np.array(g[1]).tobytes() for g in got], pa.binary())],
                                             ["doc_id", "quality", "words", "stats"])
    kind = src.schema["doc_id"].dataType.simpleString()
    rows = src.mapInArrow(run, f"doc_id {kind}, quality int, words binary, stats binary").orderBy("doc_id", "words").limit(max_rows).collect()
    return fit([(np.frombuffer(r["words"], np.int32), np.frombuffer(r["stats"], np.float64).tolist(), r["quality"]) for r in rows],
               buckets, rank, epochs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) per row of ``docs`` (doc_id, text, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * (rank + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        feat = Featurizer(m.buckets)
        for b in batches:
            s = [m.score(*feat(t, n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    src = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), col("n_chars").cast("long").alias("n_chars"))
    s = score(src, train(src, labels.select("doc_id", "quality"), **kw))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
