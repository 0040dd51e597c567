"""Spelling variant grouping (operator 11) by Bloom-guided neighbourhoods.

``count_words`` counts the words of whole texts (per task first, then in one
aggregate).  ``near_pairs`` finds the vocabulary words one edit apart: each
word length has its own blocked Bloom filter (256-bit blocks, one bit in each
of eight 32-bit lanes) over a rolling hash; the filters are broadcast, every
word probes the hashes of its own edits, and only the edits that pass are
spelled out and shuffled to an exact join with the vocabulary, which removes
false positives.  Of an unordered pair one side is generated: the longer word
deletes (the first letter of a run of equal ones), the word with the smaller
letter replaces; the join's result is used both ways.

Filters are built by an aggregate over blocks.  What is broadcast at once is
at most ``max_bytes``: a length with many words is cut into hash shards, and
shards that do not fit together are probed in further passes over the
vocabulary.  Which shard an edit belongs to is part of its hash, so every edit
is probed once, whatever the number of passes.

Forms point from a word to a near word that is ``ratio`` times as frequent, so
chains are short (a logarithm of the largest count); roots come from pointer
doubling, one join a round.

Defined cases: null texts have no words; a null id is written as nothing
before the colon; rows count as often as they occur, equal ones too; an empty
table (or no word frequent enough) gives no row; extra columns are not read.
A text may be one single run: its length bounds a task's memory, nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import LOWER_BYTES, col, stored

#: Maximal runs of these letters are words (after lower-casing A-Z).
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 300_000
#: Texts above this size are searched without a list of all their words.
LONG_TEXT = 4 << 20
#: Letters hashed together, about.
SLICE_LETTERS = 1 << 20


# ---------------------------------------------------------------- words
def _run_counts(text: str, pattern: re.Pattern) -> Counter:
    low = text.encode("utf-8", "replace").translate(LOWER_BYTES).decode()
    return Counter(pattern.findall(low)) if len(low) <= LONG_TEXT else Counter(m.group() for m in pattern.finditer(low))


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 6, min_count: int = 5, damage: int = 199) -> DataFrame:
    """``word``, ``n``: the words of at least ``min_chars`` code points that
    occur at least ``min_count`` times.  A run loses the code point at h mod
    its length where ``damage`` divides h, the unsigned crc32 of
    ``<id>:<lower-cased run>``."""
    src = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), col(text).alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shorter runs cannot give a word, with or without a deletion
        pattern = re.compile(f"[{LETTERS}]{{{min_chars},}}")
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return b
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                seed = zlib.crc32(f"{i}:".encode())
                for w, n in _run_counts(t, pattern).items():
                    h = zlib.crc32(w.encode(), seed)
                    if not h % damage:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()
    words = src.mapInArrow(run, "word string, n bigint").where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- hashes and filters
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers n - 1 .. 0 (modulo 2**64)."""
    p = np.full(n, _BASE, _U)
    p[:1] = 1
    return np.cumprod(p, dtype=_U)[::-1]


def _terms(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(_U) + _U(0x51ED270B))


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hash (modulo 2**64) of each row of a (words, letters) matrix."""
    return (_terms(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=_U)


@dataclass(frozen=True)
class Length:
    """The filters of one word length: hash shards of ``blocks`` blocks each."""
    chars: int
    words: int
    shards: int
    blocks: int

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, block and the 32 bits that choose a bit per lane."""
        x = _mix(h)
        shard = (_mix(x + _BASE) % _U(self.shards)).astype(np.int32) if self.shards > 1 else np.zeros(len(x), np.int32)
        return shard, ((x >> _U(32)) * _U(self.blocks) >> _U(32)).astype(np.int64), x.astype(np.uint32)


def _bit(bits: np.ndarray, lane: int) -> np.ndarray:
    return (bits * np.uint32(_SALTS[lane])) >> np.uint32(27)


def probe(table: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions whose eight bits are all set, lane by lane on the survivors."""
    left = np.arange(len(block))
    for lane in range(8):
        hit = (table[block * 8 + lane] >> _bit(bits, lane)) & np.uint32(1) != 0
        left, block, bits = left[hit], block[hit], bits[hit]
    return left


def plan_filters(counts: dict[int, int], bits_per_word: int, max_bytes: int) -> list[list[tuple[Length, int]]]:
    """Passes of (length, shard), each at most ``max_bytes`` of filters."""
    passes: list[list[tuple[Length, int]]] = []
    room = 0
    for chars, words in sorted(counts.items()):
        size = -(-words * bits_per_word // 8)
        shards = max(1, -(-size * 5 // (max_bytes * 4)))  # four fifths of the bound: shards are not all equal
        x = Length(chars, words, shards, max(1, -(-size // (shards * 32))))
        for shard in range(shards):
            if not passes or x.blocks * 32 > room:
                passes.append([])
                room = max_bytes
            passes[-1].append((x, shard))
            room -= x.blocks * 32
    return passes


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points) of words of one length, in slices."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens).tolist():
        rows, step = np.nonzero(lens == n)[0], max(1, SLICE_LETTERS // max(n, 1))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            text = "".join([words[i] for i in some.tolist()])
            yield some, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), n)


def build_filters(vocabulary: DataFrame, shards: list[tuple[Length, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Filters of one pass, (length, shard) -> lanes, from an aggregate over
    blocks; what reaches the driver is the pass's own bound."""
    lengths = {x.chars: x for x, _ in shards}
    wanted = {(x.chars, s) for x, s in shards}
    lanes = [f"l{i}" for i in range(8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in _by_length(b.column(0).to_pylist()):
                x = lengths[codes.shape[1]]
                shard, block, bits = x.place(word_hashes(codes))
                for s in np.unique(shard).tolist():
                    if (x.chars, s) not in wanted:
                        continue
                    mine = shard == s
                    at, inverse = np.unique(block[mine], return_inverse=True)
                    own = np.zeros((len(at), 8), np.uint32)
                    for lane in range(8):
                        np.bitwise_or.at(own[:, lane], inverse, np.uint32(1) << _bit(bits[mine], lane))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), x.chars, np.int32)), pa.array(np.full(len(at), s, np.int32)), pa.array(at),
                         *[pa.array(own[:, i].view(np.int32)) for i in range(8)]], ["chars", "shard", "block", *lanes])
    src = vocabulary.where(F.length("word").isin(list(lengths))).select("word")
    rows = src.mapInArrow(run, "chars int, shard int, block bigint, " + ", ".join(f"{x} int" for x in lanes))
    t = rows.groupBy("chars", "shard", "block").agg(*[F.expr(f"bit_or({x})").alias(x) for x in lanes]).toArrow()
    chars, shard, block = (t.column(x).to_numpy() for x in ("chars", "shard", "block"))
    values = np.stack([t.column(x).to_numpy() for x in lanes], axis=1).astype(np.int32).view(np.uint32)
    out = {}
    for x, s in shards:
        mine = (chars == x.chars) & (shard == s)
        table = np.zeros((x.blocks, 8), np.uint32)
        table[block[mine]] = values[mine]
        out[x.chars, s] = table.reshape(-1)
    return out


# ---------------------------------------------------------------- edits
def _edits(codes: np.ndarray, alphabet: list[int], replace: bool, delete: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(letter or -1, row, position, hash) of the generated edits of words of
    one length: replacements by a larger letter, deletions of the first letter
    of a run."""
    terms, n = _terms(codes), codes.shape[1]
    own = terms * _powers(n)
    if replace:
        p = _powers(n)
        rest = own.sum(axis=1, dtype=_U)[:, None] - own
        for c in alphabet:
            row, at = np.nonzero(codes < c)
            if len(row):
                yield c, row, at, rest[row, at] + _terms(np.array([c]))[0] * p[at]
    if delete:
        before = np.zeros_like(own)
        before[:, 1:] = np.cumsum(terms[:, :-1] * _powers(n - 1), axis=1, dtype=_U)
        after = own.sum(axis=1, dtype=_U)[:, None] - np.cumsum(own, axis=1, dtype=_U)
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(first)
        yield -1, row, at, (before + after)[row, at]


def near_pairs(vocabulary: DataFrame, bits_per_word: int = 24, max_bytes: int = 64 << 20) -> DataFrame:
    """``word, n, near, near_n``: every pair of words of ``vocabulary``
    (``word`` distinct, ``n``) one edit apart, both ways.  ``vocabulary`` is
    read several times: give a stored table."""
    spark = vocabulary.sparkSession
    counts = {r["c"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect() if r["c"]}
    # distinct code points: at most the characters there are
    alphabet = sorted(ord(r["c"]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    found = None
    for shards in plan_filters(counts, bits_per_word, max_bytes):
        filters = spark.sparkContext.broadcast(build_filters(vocabulary, shards))
        lengths = {x.chars: x for x, _ in shards}

        def run(batches: Iterator[pa.RecordBatch], filters=filters, lengths=lengths) -> Iterator[pa.RecordBatch]:
            tables = filters.value
            for b in batches:
                words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows, cands = [], []
                for some, codes in _by_length(words):
                    size = codes.shape[1]
                    same, less = lengths.get(size), lengths.get(size - 1)
                    for c, row, at, h in _edits(codes, alphabet, same is not None and same.words > 1, less is not None):
                        x = same if c >= 0 else less
                        shard, block, bits = x.place(h)
                        for s in range(x.shards):
                            table = tables.get((x.chars, s))
                            if table is None:
                                continue
                            mine = np.nonzero(shard == s)[0] if x.shards > 1 else None
                            hit = probe(table, block, bits) if mine is None else mine[probe(table, block[mine], bits[mine])]
                            for r, i in zip(some[row[hit]].tolist(), at[hit].tolist()):
                                w = words[r]
                                rows.append(r)
                                cands.append(w[:i] + (chr(c) if c >= 0 else "") + w[i + 1:])
                yield pa.RecordBatch.from_arrays([pa.array([words[r] for r in rows], pa.string()), pa.array([n[r] for r in rows], pa.int64()),
                                                  pa.array(cands, pa.string())], ["word", "n", "near"])
        wanted = sorted({c for x in lengths for c in (x, x + 1)})
        hits = vocabulary.where(F.length("word").isin(wanted)).select("word", "n").mapInArrow(run, "word string, n bigint, near string")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "word string, n bigint, near string, near_n bigint")
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.join(exact, "near").select("word", "n", "near", "near_n")
    both = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


# ---------------------------------------------------------------- groups
def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (acyclic): where the chain of forms ends."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(step, "root", "left_semi").limit(1).count():
            return at
        at = stored(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def spelling_variants(docs: DataFrame, ratio: int = 5, bits_per_word: int = 24, max_bytes: int = 64 << 20, **count_options) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: per vocabulary word its number
    of near words, its form (the most frequent near word, ties to the smallest,
    if at least ``ratio`` times as frequent), and the end of its chain of forms
    (itself without a form)."""
    vocabulary = stored(count_words(docs, **count_options), "vocabulary")
    near = near_pairs(vocabulary, bits_per_word, max_bytes)
    # UTF-8 order, which strings compare by, is code-point order
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))).alias("b"))
    x = vocabulary.join(best, "word", "left")
    is_form = -F.col("b.k") >= ratio * F.col("n")
    x = stored(x.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"),
                        F.when(is_form, -F.col("b.k")).alias("form_n")), "variants")
    end = roots(x.where("form is not null"))
    return x.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
