"""Best-fit packing (operator 12) with certified bin counts.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut; the first piece takes the remainder).  Full pieces are sequences of their
own; the others are dealt to partitions of a bounded number of tokens and
rows, and each partition runs best-fit decreasing.  Dual feasible functions
(rounding functions u with the sum of u at most 1 over whatever fits into a
bin) bound from below the bins that a partition needs.

A partition that reaches its bound is certified: no packing of its documents
has fewer bins, so it keeps them all but the least filled one, the rounding
loss that only other partitions can fill.  A partition above its bound keeps
its full bins and gives the documents of all open ones.  What was given is
exchanged: dealt anew, packed again, and the new packing is taken where it has
fewer bins.  Rounds end when the open bins reach the bound of their own
lengths (counted in one aggregate of at most ``capacity`` rows), when all fits
one partition, when a round gains nothing, or after ``max_rounds``; the last
packing then stands, so ending early costs bins, never documents.

Tokens are read once; afterwards only narrow rows move, each found by a row
number that is written with it, so equal rows are dealt apart.

Defined cases: null and empty texts are the end id alone; equal rows and null
ids are packed as often as they occur; an empty table gives no row; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import col, stored, text_or_empty
from docrevise.llm.token_files import SHARD_BYTES, SLICE_BYTES, Encoder, _slices, vocabulary

CAPACITY = 1024
END_ID = 2
#: Tokens and rows of a partition, about.
PART_TOKENS = 4 << 20
PART_ROWS = 400_000
#: Rounding functions tried: 1 .. K divisions of a bin.
DIVISIONS = 24


# ---------------------------------------------------------------- tokens
def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` per piece (``ids_crc32`` of
    the piece's ids as little-endian 32-bit integers)."""
    sc, spec = docs.sparkSession.sparkContext, vocabulary(docs.sparkSession, tokenizer)
    src = docs.select(col(id_col).alias("id"), text_or_empty(col(text)).alias("text"))
    # an encoder knows more pieces the longer it runs: small input splits are read together
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    src = src.coalesce(max(sc.defaultParallelism, -(-size // SHARD_BYTES), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            if not b.num_rows:
                continue
            enc = enc or Encoder(spec.value, end=end)
            for lo, n in _slices(pc.binary_length(b.column(1)).to_pylist(), SLICE_BYTES):
                ids, sizes = enc.batch(b.column(1).slice(lo, n).to_pylist())
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = sizes - (count - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                at = (np.cumsum(sizes) - sizes)[row] + start
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[s:s + k]) for s, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- packing
def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset per item, and the fill per bin.  Items of one length are
    placed together: the bin with the least room that fits keeps fitting best
    until it has no room for another."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]  # by room
    n_bins = lo = 0
    sizes, counts = np.unique(lengths, return_counts=True)
    for size, count in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        placed_bins, placed_at, left = [], [], count

        def fill(some: np.ndarray, room: int, left: int) -> int:
            per = room // size
            some, rest = some[:-(-left // per)], some[-(-left // per):]
            if len(rest):
                open_bins[room].append(rest)
            n = min(left, per * len(some))
            placed_bins.append(np.repeat(some, per)[:n])
            placed_at.append(np.tile(capacity - room + size * np.arange(per), len(some))[:n])
            whole = n // per
            open_bins[room - per * size].append(some[:whole])
            if whole < len(some):
                open_bins[room - (n - whole * per) * size].append(some[whole:])
            return left - n
        for room in range(size, capacity + 1):
            while left and open_bins[room]:
                left = fill(open_bins[room].pop(), room, left)
        if left:
            new = np.arange(n_bins, n_bins - (-left // (capacity // size)))
            n_bins += len(new)
            fill(new, capacity, left)
        mine = order[lo:lo + count]
        bins[mine], offsets[mine] = np.concatenate(placed_bins), np.concatenate(placed_at)
        lo += count
    return bins, offsets, np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)


def bins_needed(histogram: np.ndarray, divisions: int = DIVISIONS) -> int:
    """Lower bound on the bins of capacity ``len(histogram) - 1`` for
    ``histogram[x]`` items of length x, in exact integers: the best of dual
    feasible functions.  A threshold t raises items above capacity - t to a
    whole bin and drops those below t; a division by k rounds
    (k + 1) x / capacity down to k-ths of a bin, except where it is whole."""
    cap = len(histogram) - 1
    x = np.arange(cap + 1, dtype=np.int64)
    used = np.nonzero(histogram)[0]
    best = 0
    for t in {0, *used[used * 2 <= cap].tolist(), *(cap - used[used * 2 > cap] + 1).tolist()}:
        if t * 2 > cap:
            continue
        u = np.where(x > cap - t, cap, np.where(x < t, 0, x)) if t else x
        sums = [(int((histogram * u).sum()), cap)]
        for k in range(1, divisions + 1):
            y = (k + 1) * u
            sums.append((int((histogram * np.where(y % cap == 0, u * k, y // cap * cap)).sum()), k * cap))
        best = max(best, *[-(-a // b) for a, b in sums])
    return best


def _pack_partition(capacity: int, round_no: int):
    base = (round_no + 1) << 56

    def run(t: pa.Table) -> pa.Table:
        lengths, part = t.column("length").to_numpy(), t.column("part")[0].as_py()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == bins_needed(np.bincount(lengths, minlength=capacity + 1))
        opened = fill < capacity
        if certified:
            least = int(np.argmin(fill))
            opened[np.arange(len(fill)) != least] = False
        return pa.table({"row": t.column("row"), "length": t.column("length"), "sequence_id": base + (part << 24) + bins,
                         "offset": offsets, "open": opened[bins]})
    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS, part_rows: int = PART_ROWS, max_rounds: int = 12) -> DataFrame:
    """``row, sequence_id, offset`` for the stored ``pieces`` (``row`` unique,
    ``length`` from 1 to ``capacity``)."""
    narrow = pieces.select("row", F.col("length").cast("long").alias("length"))
    done = [narrow.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, before = narrow.where(F.col("length") < capacity), None
    for round_no in range(max_rounds):
        counts = pool.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
        histogram = np.zeros(capacity + 1, np.int64)
        for r in counts:
            histogram[r["length"]] = r["n"]
        if not counts or (before is not None and before <= bins_needed(histogram)):
            break
        parts = int(max(1, -(-int((histogram * np.arange(capacity + 1)).sum()) // part_tokens), -(-int(histogram.sum()) // part_rows)))
        dealt = pool.select("row", "length", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)).alias("part"))
        packed = stored(dealt.groupBy("part").applyInArrow(
            _pack_partition(capacity, round_no), "row bigint, length bigint, sequence_id bigint, offset bigint, open boolean"), f"packed-{round_no}")
        if before is not None and packed.where("offset = 0").count() >= before:
            break
        done.append(packed.where(~F.col("open")).select("row", "sequence_id", "offset"))
        pool = packed.where("open")
        if parts == 1:
            break
        before = pool.where("offset = 0").count()
    if "sequence_id" in pool.columns:
        done.append(pool.select("row", "sequence_id", "offset"))
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    pieces = token_pieces(docs, tokenizer, capacity, end, id_col, text)
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack_pieces(pieces, capacity, **options), "row").drop("row")
