"""Benchmark decontamination (operator 5), built-in expressions only.

The benchmark's normalised n-grams (``n`` words; an item with fewer words is
one n-gram of its own length) form a hash set.  Every token window of every
document is hashed and looked up in one streaming pass (windows are generated,
hashed and probed inside one stage, never shuffled), a hash hit is verified
word by word, and only verified hits go on to a per-document summary.

The set is broadcast while it has at most ``broadcast_ngrams`` entries (checked
by a count; about 200 bytes each); beyond that the same join runs without the
hint and Spark shuffles it.

Defined cases: null texts and items have no words and no windows; an empty
benchmark hits nothing; a null item id still counts its hits but is not listed;
items with one id count as one; rows that agree in id and text share one
result, each keeping its own row; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import NOT_ALNUM, ascii_lower, col, fresh, let, stored, text_or_empty, words

N = 10
BROADCAST_NGRAMS = 1_000_000


def tokens(c: str | Column) -> Column:
    """Lower-cased alphanumeric words; null has none."""
    return words(ascii_lower(text_or_empty(c)), NOT_ALNUM)


def _windows(w: Column, n: int) -> Column:
    k = F.greatest(F.size(w) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, i + 1, k).alias(f"w{i}") for i in range(n)])


def _hash(window: Column, n: int) -> Column:
    return F.xxhash64(*[window[f"w{i}"] for i in range(n)])


def benchmark_ngrams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct n-grams: len, hash, gram (words joined by spaces), items."""
    items = benchmark.select(col(id_col).cast("string").alias("item"), tokens(col(text)).alias("w")).where(F.size("w") > 0)
    grams = F.when(F.size("w") < n, F.array(F.col("w"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.slice("w", i, n)))
    g = items.select("item", F.explode(grams).alias("w"))
    g = g.groupBy(F.size("w").alias("len"), F.concat_ws(" ", "w").alias("gram")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    split = F.split("gram", " ", -1)
    # the same hash as a window's: the words one after another
    by_len = reduce(lambda a, k: a.when(F.col("len") == k, F.xxhash64(*[F.get(split, i) for i in range(k)])),
                    range(2, n + 1), F.when(F.col("len") == 1, F.xxhash64(F.get(split, 0))))
    return g.select("len", by_len.alias("hash"), "gram", "items")


def document_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_ngrams: int = BROADCAST_NGRAMS,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (doc_id, text): doc_id, text_hash, n_chars, n_words, n_rows
    (how often it occurs), starts (sorted (start, len) of the hit windows) and
    items (sorted ids)."""
    grams = stored(benchmark_ngrams(benchmark, n), "ngrams")
    lens = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most n rows
    few = sum(lens.values()) <= broadcast_ngrams
    w = docs.select(col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(col(text))).alias("text_hash"),
                    F.length(col(text)).alias("n_chars"), tokens(col(text)).alias("w"))
    parts = []
    # the first pass also carries every document through, hit or not
    for k in sorted(lens, key=lambda k: -lens[k]) or [n]:
        first = not parts
        x = w.select("doc_id", "text_hash", "n_chars", F.size("w").alias("n_words"),
                     (F.posexplode_outer if first else F.posexplode)(_windows(F.col("w"), k)).alias("start", "window"))
        g = grams.where(F.col("len") == k).select("hash", "gram", "items")
        g = F.broadcast(g) if few else g
        verified = (F.col("hash") == _hash(F.col("window"), k)) & (
            F.col("gram") == F.concat_ws(" ", *[F.col("window")[f"w{i}"] for i in range(k)]))
        x = x.join(g, verified, "left" if first else "inner")
        if first:
            x = x.where("items is not null or start is null or start = 0")
        hit = F.when(F.col("items").isNotNull(), F.struct("start", F.lit(k).alias("len")))
        row = F.lit(first) & (F.col("start").isNull() | (F.col("start") == 0))
        parts.append(x.select("doc_id", "text_hash", "n_chars", "n_words", hit.alias("hit"), "items", row.alias("row")))
    union = reduce(DataFrame.unionByName, parts)
    return (union.groupBy("doc_id", "text_hash", "n_chars", "n_words")
            .agg(F.count_if("row").alias("n_rows"), F.sort_array(F.collect_set("hit")).alias("starts"),
                 F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def covered_words(starts: Column) -> Column:
    """Words inside at least one of the sorted (start, len) windows."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
    return F.aggregate(starts, zero, lambda a, x: F.struct(
        (a["c"] + F.greatest(x["start"] + x["len"] - F.greatest(a["e"], x["start"]), F.lit(0))).alias("c"),
        F.greatest(a["e"], x["start"] + x["len"]).alias("e")), lambda a: a["c"])


def _with_hits(docs: DataFrame, hits: DataFrame, id_col: str, text: str, how: str) -> tuple[DataFrame, str]:
    """``docs`` joined to ``hits``, whose columns get a prefix of their own."""
    p = fresh(docs, "h_")
    h = hits.select(*[F.col(c).alias(p + c) for c in hits.columns])
    same = (col(id_col).eqNullSafe(F.col(f"{p}doc_id")) & (F.xxhash64(text_or_empty(col(text))) == F.col(f"{p}text_hash"))
            & F.length(col(text)).eqNullSafe(F.col(f"{p}n_chars")))
    return docs.join(h, same, how), p


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark window."""
    hits = stored(document_hits(docs, benchmark, n, id_col=id_col, text=text).where(F.size("starts") > 0)
                  .select("doc_id", "text_hash", "n_chars"), "hits")
    return _with_hits(docs, hits, id_col, text, "left_anti")[0]


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of the text: what stands before,
    between and after the hit spans stays as it is."""
    hits = stored(document_hits(docs, benchmark, n, id_col=id_col, text=text).where(F.size("starts") > 0)
                  .select("doc_id", "text_hash", "n_chars", "starts"), "hits")
    j, p = _with_hits(docs, hits, id_col, text, "left")
    starts = F.col(f"{p}starts")
    # the text as word, gap, word, gap, ...: both kept, in order
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(col(text), F.lit(f"({word}|{gap})"), 1)
    is_word = lambda x: x.rlike(f"^{word}")
    # sorted, disjoint spans of hit words (end exclusive)
    spans = F.aggregate(starts, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(-1)) >= x["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(F.get(acc, F.size(acc) - 1)["b"], x["start"] + x["len"]).alias("b"))))
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("a"), (x["start"] + x["len"]).alias("b"))))))

    def kept(text_pieces: Column, sp: Column) -> Column:
        lead = F.when(is_word(F.get(text_pieces, 0)), 0).otherwise(1)  # word k is piece 2 k + lead
        ends = F.concat(F.array(F.lit(0)), F.transform(sp, lambda x: 2 * (x["b"] - 1) + lead + 1))
        begins = F.concat(F.transform(sp, lambda x: 2 * x["a"] + lead), F.array(F.size(text_pieces)))
        between = F.arrays_zip(ends.alias("a"), begins.alias("b"))
        return F.array_join(F.flatten(F.transform(between, lambda x: F.slice(text_pieces, x["a"] + 1, x["b"] - x["a"]))), "")
    cut = F.when(F.size(starts) > 0, let(pieces, lambda tp: let(spans, lambda sp: kept(tp, sp)))).otherwise(col(text))
    return j.select(*[cut.alias(c) if c == text else col(c) for c in docs.columns])
