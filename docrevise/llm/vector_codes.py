"""Vector code compression (operator 13): product quantisation in exact
integer arithmetic, with limb-split matrix products.

Components become integers floor(scale * x).  A distance's dot product is
computed by BLAS in float64 on limbs: integers are split into signed 16-bit
digits, so every product of limb matrices stays far below 2**53 and is exact;
the products are shifted and added in int64.  The nearest entry is the first
minimum of |c|**2 - 2 x.c.

Each round is one pass over the stored integers: tasks assign their rows and
pass on a sum and a count per (part, entry); the driver sees those few rows of
one aggregate and makes the next codebook.  The totals of the labels are
joined back by broadcast while they are few, else with salted keys.

Defined cases: rows with a null vector, or one with a null or non-finite
component, are dropped.  So are components whose squared distances would not
fit 64 bits (2**27 after scaling, for 64 dimensions), and vectors that have
not the length of the smallest kept id's.  Parts differ by one component where
the length does not divide.  With fewer rows than entries the codebook is
smaller; equal ids are ordered by their vectors; null ids come last.  An empty
table gives no row; null labels form one group; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import col, stored

LIMB = 16
#: Labels whose totals are broadcast (16 bytes each and their keys).
FEW_LABELS = 200_000
SALTS = 64


# ---------------------------------------------------------------- exact products
def limbs(a: np.ndarray) -> list[np.ndarray]:
    """Signed 16-bit digits of int64 values, lowest first, as float64."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((a + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> LIMB
        if not a.any():
            return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 matrices whose result fits int64.  A limb product is at
    most 2**30, so sums of up to 2**22 of them are exact in float64."""
    total = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b)
    for i, x in enumerate(limbs(a)):
        for j, y in enumerate(right):
            total += (x @ y).astype(np.int64) << LIMB * (i + j)
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row of ``x`` and its squared distance."""
    score = (entries * entries).sum(axis=1) - 2 * exact_product(x, np.ascontiguousarray(entries.T))
    best = score.argmin(axis=1)
    return best, (x * x).sum(axis=1) + score[np.arange(len(x)), best]


def part_bounds(size: int, parts: int) -> list[int]:
    return [i * size // parts for i in range(parts + 1)]


# ---------------------------------------------------------------- the codebook
def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096) -> DataFrame:
    """``id, label, v`` (array of bigint) of the rows whose components are all
    finite and small enough."""
    kept = vectors.select(col(id_col).alias("id"), col(label).alias("label"), col(vector).alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double") * scale) < _most(F.size("x")), F.lit(False))))
    x = F.transform("x", lambda c: F.floor(c.cast("double") * scale))
    return kept.select("id", "label", x.alias("v"))


def _most(size):
    """Largest magnitude with size * (2 * m) ** 2 < 2**62."""
    return F.floor(F.sqrt(F.lit(2.0 ** 60) / F.greatest(size, F.lit(1))))


def _matrix(v: pa.Array, size: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), size)


def train(data: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """Codebooks per part, from stored ``id, v`` rows of one length."""
    spark = data.sparkSession
    first = [r["v"] for r in data.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return []
    start = np.array(first, np.int64).reshape(len(first), -1)
    size = start.shape[1]
    cut = part_bounds(size, parts)
    books = [start[:, a:b] for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, sums, counts = shared.value, None, None
            for b in batches:
                x = _matrix(b.column(0), size)
                if sums is None:
                    sums = [np.zeros(k.shape, np.int64) for k in now]
                    counts = [np.zeros(len(k), np.int64) for k in now]
                for p, book in enumerate(now):
                    own = x[:, cut[p]:cut[p + 1]]
                    at, _ = nearest(own, book)
                    np.add.at(sums[p], at, own)
                    counts[p] += np.bincount(at, minlength=len(book))
            if sums is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(k), p, np.int32) for p, k in enumerate(now)])),
                     pa.array(np.concatenate([np.arange(len(k), dtype=np.int32) for k in now])), pa.array(np.concatenate(counts)),
                     pa.array([row.tolist() for s in sums for row in s], pa.list_(pa.int64()))], ["part", "entry", "n", "s"])
        rows = data.select("v").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
        # sums of 64-bit values per component; a decimal does not overflow
        comps = rows.select("part", "entry", "n", F.posexplode_outer("s").alias("pos", "c")).groupBy("part", "entry", "pos").agg(
            F.sum("n").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("c"))
        books = [k.copy() for k in books]
        for r in comps.collect():
            if r["n"] and r["pos"] is not None:
                books[r["part"]][r["entry"], r["pos"]] = int(r["c"]) // r["n"]
    return books


def encode(data: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` per row."""
    shared = data.sparkSession.sparkContext.broadcast(books)
    cut = np.cumsum([0, *[k.shape[1] for k in books]]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            x = _matrix(b.column(2), cut[-1])
            code, error = [], np.zeros(len(x), np.int64)
            for p, book in enumerate(shared.value):
                at, d = nearest(x[:, cut[p]:cut[p + 1]], book)
                code.append(hexes[at])
                error += d
            joined = ["".join(c) for c in zip(*code)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(joined, pa.string()), pa.array(error)], ["id", "label", "code", "error"])
    kinds = [f"{c} {data.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    return data.select("id", "label", "v").mapInArrow(run, ", ".join([*kinds, "code string", "error bigint"]))


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for k in books for row in k.tolist() for x in row)


def label_totals(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """``coded`` (stored) with ``label_error``, the sum of ``error`` over equal labels."""
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if totals.limit(few + 1).count() <= few:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    # one label may hold a third of the rows: its rows meet a copy of the total per salt
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = coded.withColumn("own", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return own.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))).drop("of", "own", "salt")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                     parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` per kept row."""
    data = stored(quantised(vectors, id_col, vector, label, scale), "quantised")
    head = data.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if head is not None:
        data = data.where(F.size("v") == head["n"])
    books = train(data, parts, entries, rounds)
    coded = stored(encode(data, books), "codes")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return label_totals(coded).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
