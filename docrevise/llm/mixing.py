"""Mixing sources to target weights by Pareto order sampling (operator 9),
built-in expressions only.

1. Every source's words are summed and its target is set by water-filling:
   targets share all words by weight, stop at ``max_repeat`` times the source
   and pass the excess on by weight.
2. A source with target / words = k + f gives each document k certain whole
   copies; the fraction f is the inclusion probability of one more.
3. Each document gets a random number u from its own key and the rank
   (u / (1 - u)) / (weight * f / (1 - f)): random odds over inclusion odds.
   The documents with the smallest ranks are taken until the source's rest of
   words is reached (a sample of fixed size, in words); the document that
   crosses the line is taken if that ends nearer to the target, and finally
   one document is exchanged in or out where that ends nearer still.

No window or group ever holds a source: ranks are cut into buckets whose word
sums give the bucket the line falls into, and only that bucket is ordered.

Defined cases: a null text has size 0, a null source is a source of its own
(last in order), documents that agree in id, source and size share one fate,
an all-empty corpus has targets 0, and nothing depends on row order, so
reruns agree.  Columns of other names pass through ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrevise.llm.common import SPACE, col, fresh, stored, text_or_empty, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
#: Documents per rank bucket, about: only one bucket of a source is ordered.
BUCKET_ROWS = 1_000


def n_words(c: str | Column) -> Column:
    return F.size(words(text_or_empty(c), SPACE)).cast("long")


def source_targets(units: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source_size, n_docs, target.  ``units`` has source,
    size and n (rows it stands for).  The windows run over one row per source."""
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    # the k smallest caps per weight stop at their cap; the level of the rest
    # is the largest l with sum(min(w * l, cap)) = all words
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
                     / F.sum("w").over(rest))
    s = s.withColumn("holds", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(whole)["level"])
    target = F.least(F.col("level") * F.col("w"), F.col("cap").cast("double"))
    return s.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) from the key's md5 (52 bits), the same everywhere."""
    text = F.concat_ws("\x1f", F.lit(SEED), *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def rank_odds(u: Column, share: Column, weight: Column) -> Column:
    """Random odds over inclusion odds (documents with a small value come first)."""
    return F.try_divide(u / (1 - u), weight * share / (1 - share))


def _bucket(rank: Column, n_buckets: Column) -> Column:
    """rank / (1 + rank) lies in (0, 1) and rises with the rank."""
    return F.floor(rank / (1 + rank) * n_buckets)


def _taken(t, c) -> Column:
    """Does a unit come at or before its source's cut, in the order bucket,
    rank, id (nulls first), size?  ``t`` and ``c`` give the unit's and the
    source's columns by name."""
    rank = rank_odds(t("u"), c("share"), t("weight"))
    own = F.struct(rank.alias("rank"), t("doc_id").isNotNull().alias("known"), t("doc_id").alias("doc_id"), t("size").alias("size"))
    bucket = _bucket(rank, c("n_buckets"))
    return F.coalesce((c("share") > 0) & ((bucket < c("line")) | ((bucket == c("line")) & (own <= c("cut")))), F.lit(False))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target, whole (certain
    copies), share (inclusion probability of one more), n_buckets, line and
    cut (the bucket and the unit that the sample ends with) and swap (the unit
    exchanged at the end).  ``docs`` has doc_id, source, size and weight."""
    units = docs.groupBy("doc_id", "source", "size", "weight").agg(F.count("*").alias("n"))
    units = stored(units.withColumn("u", _uniform(F.col("doc_id"), F.col("source"), F.col("size"))), "mix-units")
    s = source_targets(units, weights, max_repeat)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    s = s.withColumn("whole", F.least(F.floor(ratio), F.lit(max_repeat)).cast("int"))
    s = s.withColumn("share", F.when(F.col("whole") < max_repeat, ratio - F.col("whole")).otherwise(F.lit(0.0)))
    s = s.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    s = stored(s.withColumn("n_buckets", F.greatest(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(1))), "mix-sources")

    same = F.col("t.source").eqNullSafe(F.col("s.source"))
    rank = rank_odds(F.col("t.u"), F.col("s.share"), F.col("t.weight"))
    r = (units.alias("t").join(s.where("share > 0").alias("s"), same)
         .select("t.*", "s.rest", rank.alias("rank"), _bucket(rank, F.col("s.n_buckets")).alias("bucket"),
                 (F.col("t.size") * F.col("t.n")).alias("words")))
    sums = r.groupBy("source", "bucket").agg(F.sum("words").alias("words"), F.max("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    line = stored(sums.where("base < rest and base + words >= rest").select("source", "bucket", "base"), "mix-lines")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = (r.alias("t").join(line.alias("s"), same & (F.col("t.bucket") == F.col("s.bucket")))
              .select("t.*", "s.base").withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0))))
    # taken: ends at or before the line, or crosses it and ends nearer than it started
    end = F.col("start") + F.col("words")
    taken = (end <= F.col("rest")) | ((F.col("start") < F.col("rest")) & (end - F.col("rest") <= F.col("rest") - F.col("start")))
    cut = inside.groupBy("source").agg(
        F.max(F.when(taken, F.struct("rank", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size"))).alias("cut"),
        F.max("bucket").alias("line"), F.coalesce(F.max(F.when(taken, end)), F.min("base")).alias("got"))
    c = s.alias("t").join(cut.alias("s"), same, "left").select("t.*", "s.cut", "s.line", "s.got")
    c = stored(c.withColumn("miss", F.when(F.col("share") > 0, F.col("rest") - F.col("got")).otherwise(F.lit(0.0))), "mix-cuts")

    # one exchange: the unit outside (inside) whose words come nearest to what is missing (over)
    u = units.alias("t").join(c.where("share > 0").alias("s"), same).select(
        "t.*", "s.miss", _taken(lambda x: F.col(f"t.{x}"), lambda x: F.col(f"s.{x}")).alias("in"),
        (F.col("t.size") * F.col("t.n")).alias("words"))
    gain = F.abs("miss") - F.abs(F.col("miss") + F.when(F.col("in"), F.col("words")).otherwise(-F.col("words")))
    fit = u.withColumn("gain", gain).where("gain > 0 and `in` = (miss < 0)")
    swap = fit.groupBy("source").agg(F.max(F.struct("gain", "u", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")).alias("swap"))
    return (c.alias("t").join(swap.alias("s"), same, "left")
            .select("t.source", "t.source_size", "t.target", "t.whole", "t.share", "t.n_buckets", "t.line", "t.cut", "s.swap"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights=WEIGHTS, max_repeat: int = MAX_REPEAT, weight: str | None = None, prefix: str = "m_") -> DataFrame:
    """``docs`` plus ``prefix`` + size, source_size, target, copies, taken.
    ``weight`` names a positive column that multiplies a document's inclusion
    odds (null: 1).  Columns that start with ``prefix`` are replaced."""
    p = prefix
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith(p.lower())])
    sized = docs.withColumn(f"{p}size", n_words(col(text))).withColumn(
        f"{p}weight", F.coalesce(col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0))
    unit = {"doc_id": col(id_col), "source": col(source), "size": F.col(f"{p}size"), "weight": F.col(f"{p}weight"),
            "u": _uniform(col(id_col), col(source), F.col(f"{p}size"))}
    plan = plan_mix(sized.select(*[unit[c].alias(c) for c in ("doc_id", "source", "size", "weight")]), weights, max_repeat)
    plan = stored(plan.select(*[F.col(c).alias(f"{p}{'key' if c == 'source' else c}") for c in plan.columns]), "mix-plan")
    j = sized.join(plan, col(source).eqNullSafe(F.col(f"{p}key")), "left")
    swap = F.col(f"{p}swap")
    swapped = F.coalesce((swap["u"] == unit["u"]) & swap["doc_id"].eqNullSafe(unit["doc_id"]) & (swap["size"] == unit["size"]), F.lit(False))
    extra = _taken(unit.__getitem__, lambda x: F.col(p + x))
    copies = F.col(f"{p}whole") + F.when(extra != swapped, 1).otherwise(0)
    return j.select(*[col(c) for c in docs.columns], F.col(f"{p}size"), F.col(f"{p}source_size"), F.col(f"{p}target"),
                    copies.cast("int").alias(f"{p}copies"), (F.col(f"{p}size") * copies).alias(f"{p}taken"))


def repeat_documents(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    p = fresh(docs, "m_")
    return (mix(docs, prefix=p, **kw).where(F.col(f"{p}copies") > 0)
            .withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies"))))
            .select(*[col(c) for c in docs.columns]))
