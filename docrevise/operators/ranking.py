"""Chunk scoring and ranking: P1-P5.

P1 asks, for every chunk and every target of its job, whether the target (or
one of its halves) stands in the chunk.  Chunks of one job are taken together
per ``group_chars`` characters of the document, targets per ``shard_chars``;
each pair of a group and a shard is one row, so a long document, or one with
very many targets, becomes many rows of bounded size.  Everything here is dealt
by job, as ranking needs it: chunk texts are shuffled once, or not at all where
the jobs come dealt by job.  Inside a row, few or short
chunks are searched target by target; otherwise one multi-pattern
(Aho-Corasick) automaton reads every chunk once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import div, str_array


# ---------------------------------------------------------------- P1 target score
def _finder(patterns: list[str], n_chars: int):
    """``first(text)``: the first place (or -1) of every pattern in a text.
    ``n_chars``: the length of all texts to be searched."""
    # reading a text once per pattern costs about 1/50 of adding a character to an automaton
    if len(patterns) * n_chars <= 50 * sum(map(len, patterns)):
        return lambda text: [text.find(p) for p in patterns]
    import ahocorasick
    a, same = ahocorasick.Automaton(), {}
    for i, p in enumerate(patterns):
        same.setdefault(p, []).append(i)
    empty = same.pop("", [])
    for p, numbers in same.items():
        a.add_word(p, (len(p), numbers))
    a.make_automaton()

    def first(text: str) -> list[int]:
        out = [-1] * len(patterns)
        for i in empty:
            out[i] = 0
        if same:
            for end, (n, numbers) in a.iter(text):
                if out[numbers[0]] < 0:
                    for i in numbers:
                        out[i] = end - n + 1
        return out
    return first


def _places(patterns: list[str], texts: list[str]) -> list[dict[int, int]]:
    """Per text {number of a pattern: its first place} of the patterns that
    stand in it."""
    out: list[dict[int, int]] = [{} for _ in texts]
    # reading a character for one pattern takes 0.2 to 0.4 ns, adding one to an automaton 100 to 220 ns (measured)
    if len(patterns) * sum(map(len, texts)) <= 300 * sum(map(len, patterns)):
        # all texts are searched as one; a place that reaches into the next text is none
        whole, starts = "\n".join(texts), [0]
        for text in texts:
            starts.append(starts[-1] + len(text) + 1)
        for i, x in enumerate(patterns):
            p = whole.find(x)
            while p >= 0:
                k = bisect_right(starts, p) - 1
                if p + len(x) < starts[k + 1]:
                    out[k][i] = p - starts[k]
                    p = starts[k + 1] - 1
                p = whole.find(x, p + 1) if k + 1 < len(texts) or p + 1 < len(whole) else -1
        return out
    first = _finder(patterns, sum(map(len, texts)))
    return [{i: p for i, p in enumerate(first(text)) if p >= 0} for text in texts]


def score_targets(jobs: DataFrame, chunks: DataFrame, targets: DataFrame,
                  contained: int = K.SCORE_CONTAINED, first_third: int = K.SCORE_FIRST_THIRD,
                  middle_third: int = K.SCORE_MIDDLE_THIRD, half: int = K.SCORE_HALF,
                  half_min_len: int = K.HALF_MIN_TARGET_LEN, group_chars: int = 1 << 19, shard_chars: int = 1 << 21) -> DataFrame:
    """(job_id, chunk_no, target_score, n_targets) for every chunk;
    ``n_targets`` is the number of the job's distinct targets.

    ``targets`` has (job_id, target, n); ``n`` repeats count ``n`` times.
    Per target, case-insensitively: contained -> ``contained`` points plus
    ``first_third`` if its first position in the chunk is below len div 3,
    else ``middle_third`` if below 2*len div 3; otherwise, for targets longer
    than ``half_min_len``, ``half`` points for each contained half.  An empty
    target stands at the start of every chunk.
    """
    group = div(F.col("start"), group_chars)
    grouped = chunks.select("job_id", group.alias("g"), F.struct(F.col("chunk_no").cast("int").alias("no"), F.lower("text").alias("low"),
                                                                  F.length("text").alias("n")).alias("c"))
    grouped = grouped.groupBy("job_id", "g").agg(F.collect_list("c").alias("chunks"))
    sized = targets.select("job_id", F.lower("target").alias("t"), F.col("n").cast("long").alias("n"))
    before = Window.partitionBy("job_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    shards = (sized.withColumn("shard", div(F.sum(F.length("t")).over(before), shard_chars))
              .groupBy("job_id", "shard").agg(F.collect_list(F.struct("t", "n")).alias("targets")))
    last = F.greatest(div(F.col("n_chars") - 1, group_chars), F.lit(0))
    spread = shards.join(jobs.select("job_id", last.alias("last")), "job_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            job, no, score, many = [], [], [], []
            # lists of plain values: a Python dictionary per chunk and target would cost more than the search
            c, t = b.column(1), b.column(2)
            cs, ts = c.flatten(), t.flatten()
            c_no, c_low, c_n = (cs.field(k) for k in range(3))
            t_text, t_n = (ts.field(k) for k in range(2))
            c_end, t_end = c.value_lengths().to_pylist(), t.value_lengths().to_pylist()
            c0 = t0 = 0
            for j, nc, nt in zip(b.column(0).to_pylist(), c_end, t_end):
                nt = nt or 0
                patterns, weights = t_text.slice(t0, nt).to_pylist(), t_n.slice(t0, nt).to_pylist()
                half_of = {}
                for i, x in enumerate(patterns[:]):
                    if len(x) > half_min_len:
                        half_of[len(patterns)] = half_of[len(patterns) + 1] = i
                        patterns += [x[:len(x) // 2], x[len(x) // 2:]]
                places = _places(patterns, c_low.slice(c0, nc).to_pylist())
                for k, n, at in zip(c_no.slice(c0, nc).to_pylist(), c_n.slice(c0, nc).to_pylist(), places):
                    points = 0
                    for i, p in at.items():
                        if i < nt:
                            points += weights[i] * (contained + (first_third if p < n // 3 else middle_third if p < n * 2 // 3 else 0))
                        elif half_of[i] not in at:
                            points += weights[half_of[i]] * half
                    job.append(j)
                    no.append(k)
                    score.append(points)
                    many.append(nt)
                c0, t0 = c0 + nc, t0 + nt
            yield pa.RecordBatch.from_arrays([pa.array(job, pa.string()), pa.array(no, pa.int32()), pa.array(score, pa.int64()),
                                              pa.array(many, pa.int64())], ["job_id", "chunk_no", "points", "many"])
    # on the job alone: chunks and targets that are dealt by job stay where they are
    pairs = (grouped["job_id"] == spread["job_id"]) & (grouped["g"] <= spread["last"])
    rows = grouped.join(spread, pairs, "left").select(grouped["job_id"], "chunks", "targets")
    per_shard = rows.mapInArrow(run, "job_id string, chunk_no int, points long, many long")
    # dealt by job like the chunks: bringing the points to them moves no text
    return per_shard.repartition("job_id").groupBy("job_id", "chunk_no").agg(F.sum("points").alias("target_score"), F.sum("many").alias("n_targets"))


# ---------------------------------------------------------------- P2 marker score
def score_markers(chunks: DataFrame, markers=None, weight: int = K.SCORE_MARKER) -> DataFrame:
    """``weight`` per structure marker present in the lower-cased chunk."""
    markers = markers or K.STRUCTURE_MARKERS
    lt = F.lower(F.col("text"))
    n = F.size(F.filter(str_array(markers), lambda m: F.call_function("contains", lt, m)))
    return chunks.withColumn("marker_score", (n * weight).cast("long"))


# ---------------------------------------------------------------- P3 rank
def rank_chunks(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """``rank`` 1.. by score descending, then chunk number."""
    w = Window.partitionBy("job_id").orderBy(F.col(score_col).desc(), F.col("chunk_no").asc())
    return scored.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- P4 gate
def apply_ranking_gate(ranked: DataFrame, size: int = K.CHUNK_SIZE, min_chunks: int = 3) -> DataFrame:
    """Keep the score rank only for documents of at least ``size``
    characters with at least ``min_chunks`` chunks and at least one target
    (``n_targets``, from P1); otherwise ``rank`` is document order.  The last
    chunk ends where the document does.  Adds ``ranked`` (bool)."""
    w = Window.partitionBy("job_id")
    gate = (F.max("end").over(w) >= size) & (F.count(F.lit(1)).over(w) >= min_chunks) & (F.coalesce(F.col("n_targets"), F.lit(0)) > 0)
    x = ranked.withColumn("ranked", gate)
    return x.withColumn("rank", F.when(F.col("ranked"), F.col("rank")).otherwise(F.col("chunk_no") + 1)).drop("n_targets")


# ---------------------------------------------------------------- P5 top-k
def top_chunks(ranked: DataFrame, k: int) -> DataFrame:
    """P5: the ``k`` best chunks per job (bounds model cost)."""
    return ranked.where(F.col("rank") <= k)


def score_chunks(jobs: DataFrame, chunks: DataFrame, targets: DataFrame, markers=None) -> DataFrame:
    """P1 + P2: chunks with ``target_score``, ``marker_score`` and ``score``."""
    ts = score_targets(jobs, chunks, targets)
    marked = score_markers(chunks, markers)
    # a join on both keys would deal the chunk texts out by both; a window over both kinds of rows keeps them with their job
    w = Window.partitionBy("job_id", "chunk_no")
    x = marked.withColumn("_chunk", F.lit(True)).unionByName(ts, allowMissingColumns=True)
    x = x.withColumns({c: F.max(c).over(w) for c in ("target_score", "n_targets")})
    x = x.where("_chunk and job_id is not null and chunk_no is not null and target_score is not null")
    return x.select("job_id", "chunk_no", *[c for c in marked.columns if c not in ("job_id", "chunk_no")], "target_score", "n_targets",
                    (F.col("target_score") + F.col("marker_score")).alias("score"))
