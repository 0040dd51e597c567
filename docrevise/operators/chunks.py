"""Chunking: C1-C5.

Chunks are described by offsets (``start``, ``end``) into the job's text;
the chunk text is cut once by ``substring``.  Downstream operators that only
need positions (scoring, P1) never touch the chunk text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import html_escape

def _cut(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "chunk_text", F.call_function("substring", F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))


# ---------------------------------------------------------------- C2 fixed width
def chunk_fixed(jobs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` characters.

    The last window ends at the text end; a window that would lie wholly
    inside the previous one's overlap is not produced; an empty text gives
    one empty chunk.  Output: job_id, doc_id, chunk_no, start, end, text.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.col("n_chars")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    x = jobs.select("job_id", "doc_id", "text", "n_chars", F.posexplode(starts).alias("chunk_no", "start"))
    x = x.withColumn("end", F.least(F.col("start") + size, n))
    return _cut(x).select("job_id", "doc_id", "chunk_no", "start", "end", F.col("chunk_text").alias("text"))


# ---------------------------------------------------------------- C1 recursive
def chunk_recursive(jobs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                    separators=None) -> DataFrame:
    """Overlapping chunks of at most ``size`` characters that prefer to end
    after the coarsest separator available ("\\n\\n", then "\\n", then " ",
    then any character).

    Contract (see README): text = original[start, end); length <= size; the
    cut is placed after the last occurrence of the coarsest separator found in
    the cut zone (the second half of the window, or less when ``overlap``
    exceeds a third of ``size``), a character
    cut only if none; the next chunk starts at the earliest separator
    boundary inside the previous chunk's last ``overlap`` characters (coarsest
    separator first), else at the previous end; starts and ends strictly
    increase; the chunks cover the text; an empty text gives one empty chunk.

    Each step only reads the window of one chunk, so the walk is linear in
    the text length; it runs in the JVM with ``aggregate`` over a bounded
    ``sequence`` (one step per chunk).
    """
    seps = [s for s in (separators or K.CHUNK_SEPARATORS) if s != ""]
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    # cuts are searched in the second half of the window (less if the overlap
    # is large), so every step advances by at least size - zone - overlap
    zone = max(1, min(size // 2, size - overlap - 1)) if size - overlap > 1 else 1
    progress = max(size - zone - overlap, 1)
    n = F.col("n_chars")
    text = F.col("text")

    def let(value, body):
        # bind `value` once (lambda functions get no common-subexpression elimination)
        return F.transform(F.array(value), body)[0]

    def cut_end(start):
        lo = start + F.lit(size - zone)

        def in_tail(tl):
            def with_len(tlen):
                cands = [F.when(F.call_function("contains", tl, F.lit(sep)),
                                lo + tlen - F.length(F.substring_index(tl, sep, -1))) for sep in seps]
                return F.coalesce(*cands, start + size)  # coarsest separator first
            return let(F.length(tl), with_len)

        return F.when(start + size >= n, n).otherwise(
            let(F.call_function("substring", text, lo + 1, F.lit(zone)), in_tail))

    def next_start(start, end):
        lo = F.greatest(end - overlap, start + 1)

        def boundary(sep):
            return lambda p: F.when((p > 0) & (lo + p - 1 + len(sep) < end), lo + p - 1 + len(sep))

        def in_zone(z):
            cands = [let(F.call_function("locate", F.lit(sep), z), boundary(sep)) for sep in seps]
            return F.coalesce(*cands, end)  # coarsest separator first

        return F.when(end >= n, n).otherwise(let(F.call_function("substring", text, lo + 1, end - lo), in_zone))

    max_chunks = (F.ceil(n / F.lit(progress)) + 2).cast("int")
    init = F.struct(F.lit(0).cast("long").alias("s"),
                    F.array().cast("array<struct<start:bigint,end:bigint>>").alias("acc"))

    def step(st, _i):
        s = st["s"]
        done = (s >= n) & (F.size(st["acc"]) > 0)
        advance = let(cut_end(s).cast("long"), lambda e: F.struct(
            next_start(s, e).cast("long").alias("s"),
            F.array_append(st["acc"], F.struct(s.alias("start"), e.alias("end"))).alias("acc")))
        return F.when(done, st).otherwise(advance)

    walk = F.aggregate(F.sequence(F.lit(1), max_chunks), init, step)
    x = jobs.select("job_id", "doc_id", "text", "n_chars", F.posexplode(walk["acc"]).alias("chunk_no", "r"))
    x = x.select("job_id", "doc_id", "chunk_no", "text", F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    return _cut(x).select("job_id", "doc_id", "chunk_no", "start", "end", F.col("chunk_text").alias("text"))


# ---------------------------------------------------------------- C3 small-document bypass
def text_page(text_col) -> F.Column:
    """The ``<pre>`` page the reference builds for plain-text input."""
    return F.concat(F.lit("<!DOCTYPE html><html><body><pre>"), html_escape(text_col), F.lit("</pre></body></html>"))


def small_document_chunks(jobs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                          use_html: bool = True, chunker=None) -> DataFrame:
    """Documents shorter than ``size`` are one chunk - the HTML rendering if
    it is longer than the text (hosted variant), else the text; longer
    documents go through ``chunker`` (C1 by default).  ``start``/``end``
    refer to the text; ``is_html`` marks the bypass rendering."""
    chunker = chunker or chunk_recursive
    small = jobs.where(F.col("n_chars") < size)
    html = F.coalesce(F.col("html"), text_page(F.col("text"))) if "html" in jobs.columns else text_page(F.col("text"))
    one = small.select("job_id", "doc_id", F.lit(0).alias("chunk_no"), F.lit(0).cast("long").alias("start"),
                       F.col("n_chars").cast("long").alias("end"),
                       (F.when(F.length(html) > F.col("n_chars"), html).otherwise(F.col("text")) if use_html
                        else F.col("text")).alias("text"),
                       (F.length(html) > F.col("n_chars") if use_html else F.lit(False)).alias("is_html"))
    big = chunker(jobs.where(F.col("n_chars") >= size), size, overlap).withColumn("is_html", F.lit(False))
    return one.unionByName(big)


# ---------------------------------------------------------------- C4 labels
def label_chunks(chunks: DataFrame) -> DataFrame:
    """C4: ``n_chunks`` per job and the ``i/n`` label (1-based)."""
    w = Window.partitionBy("job_id")
    return (chunks.withColumn("n_chunks", F.count(F.lit(1)).over(w))
            .withColumn("label", F.concat((F.col("chunk_no") + 1).cast("string"), F.lit("/"),
                                          F.col("n_chunks").cast("string"))))


# ---------------------------------------------------------------- C5 output budget
def output_budget(chunks: DataFrame, cap: int = K.MAX_OUTPUT_TOKENS, pad: int = K.OUTPUT_TOKEN_PAD) -> DataFrame:
    """``min(cap, characters + pad)`` output tokens per chunk."""
    return chunks.withColumn("max_tokens", F.least(F.length("text") + pad, F.lit(cap)))
