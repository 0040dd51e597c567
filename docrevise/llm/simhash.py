"""SimHash near-duplicates (operator 4): fingerprints, links at a small
Hamming distance found by a binary-trie self-join, connected components.

Links.  Equal fingerprints collapse first.  The distinct ones form a binary
trie (a sorted array: a node is a range that shares a bit prefix).  The trie
is joined with itself top-down: a pair of nodes splits into its child pairs, a
pair of unlike bits costs one of the error budget, and a pair is pruned when
the budget is spent, or when both its ranges already lie in one component.
Because 4 differing bits leave at least one of 5 blocks (two of 6, three of 7)
untouched, the join runs once per choice of untouched blocks, with these
blocks as the trie's first levels and a budget of 0 there: no pair is lost and
far fewer are visited.  5 blocks serve up to about 67 million distinct
fingerprints, 6 up to 3 * 10**10, 7 beyond.

Spread.  The first levels of a trie are done by Spark: with a budget of 0 a
subtree needs no other, so every fingerprint goes to one task per trie.  A
subtree with many fingerprints is cut into chunks and its tasks become chunk
pairs, so no task ever holds an unbounded subtree.  A task gives back a star
per local component, never pairs, and the stars are joined into components by
alternating large-star and small-star steps, stored after each round.

Defined cases: null and empty texts have no words and fingerprint 0, linked
like any other; a text of fewer words than the shingle is one shingle; null
ids are never the smallest unless a component has no other; of repeated rows
``near_dedup`` keeps one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrevise.llm.common import LOWER_BYTES, col, fresh, stored, text_or_empty

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints per subtree, and per chunk of a big one, about.
SUBTREE = 1024
CHUNK = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text."""
    import xxhash
    w = text.encode().translate(LOWER_BYTES).split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1)
    joined = b" ".join(w)
    lens = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:n].tolist()
    ends = ends[min(shingle, len(w)) - 1:].tolist()
    hashes = np.array([h64(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) per row."""
    src = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(col(text))).alias("text_hash"), col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "", shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])
    return src.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


class _Labels:
    """Union-find over array positions, whole arrays at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                nxt = self.label[self.label]
                if (nxt == self.label).all():
                    break
                self.label = nxt

    def runs(self, index: np.ndarray) -> np.ndarray:
        """Run numbers: a range is of one component iff both ends agree."""
        lab = self.label[index]
        return np.concatenate([[0], np.cumsum(lab[1:] != lab[:-1])]) if len(lab) else lab


def layouts(n: int, max_bits: int = MAX_BITS) -> list[list[tuple[int, int]]]:
    """Per trie the bit blocks, (offset from the top, width), in trie order:
    first those taken as untouched, enough bits for ``n`` fingerprints."""
    for blocks in (max_bits + 1, max_bits + 2, max_bits + 3):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        if n <= 1 << (sum(sorted(w for _, w in parts)[:blocks - max_bits]) + 14):
            break
    return [[parts[i] for i in first] + [x for i, x in enumerate(parts) if i not in first]
            for first in combinations(range(blocks), blocks - max_bits)]


def _exact(layout: list[tuple[int, int]], max_bits: int = MAX_BITS) -> int:
    return sum(w for _, w in layout[:len(layout) - max_bits])


def trie_join(fps: np.ndarray, exact: int, max_bits: int = MAX_BITS, leaf: int = 64, step: int = 1 << 18) -> np.ndarray:
    """Component (smallest position) of each of the sorted distinct ``fps``
    under the links that agree in the first ``exact`` bits (others may be
    joined too where they are links)."""
    labels, every = _Labels(len(fps)), np.arange(len(fps))
    for k in (1, 2, 3):  # neighbours in trie order: cheap, and joins dense clusters early
        near = np.nonzero(np.bitwise_count(fps[:-k] ^ fps[k:]) <= max_bits)[0]
        labels.union(near, near + k)
    # node pairs: two ranges (equal, or the first before the second), differing bits so far
    stack = [(0, np.array([[0, len(fps), 0, len(fps), 0]], dtype=np.int64))]
    while stack:
        d, pairs = stack.pop()
        if len(pairs) > step:
            stack.append((d, pairs[step:]))
            pairs = pairs[:step]
        run = labels.runs(every)
        a0, a1, b0, b1, e = pairs.T
        settled = (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (labels.label[a0] == labels.label[b0])
        pairs = pairs[~settled]
        a0, a1, b0, b1, e = pairs.T
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (d == 64)
        if small.any():
            _verify(pairs[small], fps, labels, max_bits)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        a0, a1, b0, b1, e = pairs.T
        bit = np.uint64(1) << np.uint64(63 - d)
        below = ~(bit | (bit - np.uint64(1)))  # the d leading bits
        am = np.clip(np.searchsorted(fps, (fps[a0] & below) | bit), a0, a1)
        bm = np.clip(np.searchsorted(fps, (fps[b0] & below) | bit), b0, b1)
        nxt = np.concatenate([np.stack(x, axis=1) for x in (
            (a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am, a1, b0, bm, e + 1))])
        budget = 0 if d < exact else max_bits
        nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget) & (nxt[:, 0] <= nxt[:, 2])]
        if len(nxt):
            stack.append((d + 1, nxt))
    return labels.label


def _verify(pairs: np.ndarray, fps: np.ndarray, labels: _Labels, max_bits: int) -> None:
    """Compare all members of small node pairs and join the linked ones."""
    a0, a1, b0, b1, _ = pairs.T
    nb = b1 - b0
    n = (a1 - a0) * nb
    for lo in range(0, len(n), 1 << 15):
        hi = lo + (1 << 15)
        m, total = n[lo:hi], int(n[lo:hi].sum())
        pos = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
        width = np.repeat(nb[lo:hi], m)
        i = np.repeat(a0[lo:hi], m) + pos // width
        j = np.repeat(b0[lo:hi], m) + pos % width
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        labels.union(i[near], j[near])


def _permuted(fps: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for offset, width in layout:
        part = (fps >> np.uint64(64 - offset - width)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | part
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Star edges (u, v) whose components are those of all links between the
    fingerprints of ``distinct`` (column fp, no repeats)."""
    n = distinct.count()
    tries = layouts(n)
    depth = min(_exact(tries[0]) - 1, max(0, (max(n, 1) - 1) // SUBTREE).bit_length())

    def prefix(layout: list[tuple[int, int]]) -> Column:
        out, left = F.lit(0).cast("long"), depth
        for offset, width in layout:
            take = min(width, left)
            if take:
                out = F.shiftleft(out, take).bitwiseOR(F.shiftrightunsigned("fp", 64 - offset - take).bitwiseAND(F.lit((1 << take) - 1)))
            left -= take
        return out

    def stars(table: pa.Table) -> pa.Table:
        layout = tries[table.column("trie")[0].as_py()]
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        rot = _permuted(fps, layout)
        order = np.argsort(rot)
        label = trie_join(rot[order], _exact(layout))
        keep = label != np.arange(len(label))
        return pa.table({"u": fps[order][keep].view(np.int64), "v": fps[order][label[keep]].view(np.int64)})

    x = distinct.select("fp", F.posexplode(F.array(*[prefix(t) for t in tries])).alias("trie", "node"))
    # big subtrees become chunk pairs
    counts = stored(x.groupBy("trie", "node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1"), "big-nodes")
    x = x.join(counts, ["trie", "node"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # with one chunk the row is alone; with more, it meets every other chunk
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")))
    x = x.withColumn("mine", mine).withColumn("other", F.explode(others))
    jobs = x.select("trie", "node", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "fp")
    return jobs.groupBy("trie", "node", "c1", "c2").applyInArrow(stars, "u bigint, v bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, centre of every node of ``edges`` (u, v), by alternating
    large-star and small-star steps until nothing changes."""
    pair = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(edges.where("u <> v").select(pair.alias("p")).select("p.*").distinct(), "stars")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        e = stored(e, "stars")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("centre"))
        seen = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id and keep_hash (the text_hash of the
    component's first document) per row of ``docs``."""
    fps = stored(fingerprints(docs, shingle, id_col, text), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    classes = stored(fps.groupBy("fp").agg(first.alias("first")), "classes")
    comp = components(links(classes.select("fp")))
    # the centre belongs to its own component: a class without an edge is its own centre
    classes = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("centre", "fp").alias("centre"))
    best = classes.groupBy("centre").agg(F.min("first").alias("best"))
    of = classes.join(best, "centre").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("keep_hash"))
    return fps.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "keep_hash")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id."""
    found = near_duplicates(docs, shingle, id_col, text)
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash"))
    p = fresh(docs, "k_")
    kept = stored(found.where(own).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept")
    h = F.xxhash64(text_or_empty(col(text)))
    side = kept.select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"))
    out = docs.join(side, col(id_col).eqNullSafe(F.col(f"{p}id")) & (h == F.col(f"{p}hash")), "left_semi")
    if kept.where("n > 1").isEmpty():
        return out
    # repeated rows: one of each stays
    w = Window.partitionBy(col(id_col), h).orderBy(F.lit(1))
    return out.withColumn(f"{p}row", F.row_number().over(w)).where(F.col(f"{p}row") == 1).drop(f"{p}row")
