"""Quality rules as a learned decision list (operator 7), built-in
expressions only.

``text_statistics`` describes a text in one row.  ``learn_rules`` runs
sequential covering over labelled statistics: a rule is grown condition by
condition (largest FOIL gain on the growing part), pruned to the prefix with
the best precision on the held-back part, and accepted if it is precise there;
the rows it covers are taken out before the next rule is grown.  When a rule
fails, the next best first condition is tried; the list ends when none is
left, not at a number of rules or conditions.  Every
step is one small distributed aggregate over binned statistics, for all open
rules at once: all labelled rows count, and the driver only sees (rule,
statistic, bin) counts.  The rules come
out as one ordered ``when`` expression.

Defined cases: a null text has no words; an empty labels table (or one
without the needed precision) gives an empty list that keeps every text; so do
labels of one class, and bad rows left without good ones add no rule, because
nothing tells them from the texts to keep; null
labels are ignored; a document with several label rows counts each of them;
extra columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import SPACE, col, fresh, let, stored, text_or_empty, words

#: Thresholds tried per statistic (fixed grids, so learning is reproducible).
_SHARES = [0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
GRIDS: dict[str, list[float]] = {
    "n_words": [5, 10, 20, 30, 50, 80, 120, 200, 400, 800, 2000, 5000],
    "mean_word_chars": [2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10, 12, 15],
    "symbol_share": _SHARES,
    "dup_line_share": _SHARES,
    "repeat_share": _SHARES,
    "distinct_share": _SHARES,
    "upper_share": _SHARES,
    "mark_share": _SHARES,
}


#: A rule stops growing after so many conditions that did not help on the pruning part.
PATIENCE = 3


def _window_hashes(w: Column, n: int) -> Column:
    """A hash per run of ``n`` consecutive words, from one hash per word."""
    def runs(h: Column) -> Column:
        k = F.size(h) - n
        return F.when(k >= 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
                      ).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(w, lambda x: F.xxhash64(x)), runs)


def _covered(starts: Column, n: int) -> Column:
    """Words inside windows of ``n`` words that start at the sorted ``starts``."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"))
    return F.aggregate(
        starts, zero,
        lambda a, i: F.struct((a["c"] + i + n - F.greatest(a["e"], i)).alias("c"), (i + n).alias("e")),
        lambda a: a["c"])


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words lying in ``n``-word windows that occur twice or more in ``w``.
    A hash set settles texts without any repeat.  The others sort hashes and
    compare the words of neighbours with equal ones; should different windows
    ever share a hash, the windows themselves are sorted, so the count is
    exact."""
    words_at = lambda i: F.slice(w, i + 1, n)

    def by_words(i: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda j, x: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])
        return let(F.sort_array(F.transform(i, lambda x: F.struct(F.array_join(words_at(x), " ").alias("k"), x.alias("i")))), marked)

    def by_hash(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return let(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), places)

    def places(alike: Column) -> Column:
        before = lambda j: F.get(alike, j - 1)
        clash = F.exists(F.transform(alike, lambda x, j: (j > 0) & (before(j)["h"] == x["h"]) & (words_at(before(j)["i"]) != words_at(x["i"]))),
                         lambda c: F.coalesce(c, F.lit(False)))
        i = F.transform(alike, lambda x: x["i"])
        return _covered(F.sort_array(F.when(clash, by_words(i)).otherwise(i)), n)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), by_hash))
    return let(_window_hashes(w, n), count)


def _statistics(t: Column) -> Column:
    """All statistics of a text as one struct; words and lines are cut once."""
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))

    def of(w: Column, lines: Column) -> Column:
        return F.struct(*[c.cast("long").alias(name) for name, c in {
            "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": F.length(t) - left(r"[#*$%&|<>]+"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_lines": F.size(lines),
            "n_repeat_words": repeated_words(w), "n_distinct": F.size(F.array_distinct(w)),
            "n_upper": F.length(t) - left("[A-Z]+"), "n_marks": F.length(t) - left("[!?]+")}.items()])
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(t, SPACE), lambda w: let(lines, lambda x: of(w, x)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks")


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """``docs`` plus one column per statistic, each named ``prefix`` + name."""
    p = prefix
    df = docs.select("*", _statistics(text_or_empty(col(text))).alias(f"{p}all"))
    return df.select(*[col(c) for c in docs.columns], *[F.col(f"{p}all.{n}").alias(p + n) for n in STATISTICS])


def columns(prefix: str = "q_"):
    """Statistic name -> column, for rows of ``text_statistics``."""
    return lambda name: F.col(prefix + name)


def base_failed(c=columns()) -> Column:
    """Fixed rule: fewer than ten words, or over a fifth of them repeated."""
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def features(c=columns()) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word_chars": share(c("word_chars"), c("n_words")),
        "symbol_share": share(c("n_symbols"), c("word_chars")),
        "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "distinct_share": share(c("n_distinct"), c("n_words")),
        "upper_share": share(c("n_upper"), c("word_chars")),
        "mark_share": share(c("n_marks"), c("word_chars")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bin: int

    @property
    def threshold(self) -> float:
        return float(GRIDS[self.feature][self.bin])

    def on_values(self, values: dict[str, Column]) -> Column:
        v = values[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class RuleList:
    """Ordered reject rules; a text that none covers is kept."""
    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, c=columns()) -> Column:
        """True = keep.  One ordered conditional expression."""
        values, out = features(c), None
        for rule in self.rules:
            cond = F.lit(True)
            for x in rule:
                cond = cond & x.on_values(values)
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules) or "(none)"


@dataclass
class _Growing:
    """A rule under construction: its conditions and, per condition, the bad
    and good rows of the pruning part that the rule covers so far."""
    conditions: list[Condition]
    held: list[tuple[int, int]]
    done: bool = False

    def box(self) -> tuple[list[int], list[int]]:
        """Bins above ``lo`` and up to ``hi``, per statistic."""
        lo, hi = {f: -1 for f in GRIDS}, {f: len(g) for f, g in GRIDS.items()}
        for c in self.conditions:
            if c.above:
                lo[c.feature] = max(lo[c.feature], c.bin)
            else:
                hi[c.feature] = min(hi[c.feature], c.bin)
        return list(lo.values()), list(hi.values())

    def best(self) -> int:
        """Last condition of the prefix with the best precision on the pruning part."""
        return max(range(len(self.held)), key=lambda i: ((self.held[i][0] - self.held[i][1]) / max(1, sum(self.held[i])), -i))

    def pruned(self, min_cover: int, min_precision: float) -> list[Condition] | None:
        """The prefix with the best precision on the pruning part, if good enough."""
        k = self.best()
        p, n = self.held[k]
        return self.conditions[:k + 1] if p >= min_cover and p / (p + n) >= min_precision else None


def _inside(box: Column) -> Column:
    """Whether a row's bins lie in a box (``lo`` and ``hi`` per statistic)."""
    out = F.lit(True)
    for i, f in enumerate(GRIDS):
        out = out & (F.col(f"b_{f}") > box["lo"][i]) & (F.col(f"b_{f}") <= box["hi"][i])
    return out


def _boxes(rules: list[_Growing]) -> Column:
    """The rules' boxes as one constant, so that every job runs the same code."""
    rows = [{"id": i, "lo": lo, "hi": hi} for i, (lo, hi) in enumerate(r.box() for r in rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<id:int,lo:array<int>,hi:array<int>>>")


def _counts(table: DataFrame, taken: list[_Growing], rules: list[_Growing]) -> list[dict[str, dict[int, tuple[int, int, int, int]]]]:
    """Per rule of ``rules``: (statistic, bin) -> bad and good rows of the
    growing part, then of the pruning part, among the rows that the rule
    covers and no rule of ``taken`` does.  One job for all rules."""
    left = table.where(~F.exists(_boxes(taken), _inside)) if taken else table
    covering = F.transform(F.filter(_boxes(rules), _inside), lambda r: r["id"])
    x = left.select("bad", "grow", "n", F.explode(covering).alias("rule"), F.array(*[F.col(f"b_{f}") for f in GRIDS]).alias("b"))
    x = x.select("bad", "grow", "n", "rule", F.posexplode("b").alias("f", "b"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_bad, grow = F.col("bad"), F.col("grow")
    rows = x.groupBy("rule", "f", "b").agg(total(is_bad & grow).alias("p"), total(~is_bad & grow).alias("n"),
                                           total(is_bad & ~grow).alias("hp"), total(~is_bad & ~grow).alias("hn")).collect()
    out: list[dict] = [{f: {} for f in GRIDS} for _ in rules]
    names = list(GRIDS)
    for r in rows:
        out[r["rule"]][names[r["f"]]][r["b"]] = (r["p"], r["n"], r["hp"], r["hn"])
    return out


def learn_rules(labelled: DataFrame, bad: str = "bad", key: str = "key", min_cover: int = 5, min_precision: float = 0.9) -> RuleList:
    """Learn reject rules from ``labelled``: statistics plus ``bad`` (boolean)
    and ``key`` (any value; its hash deals rows to the growing part, two
    thirds, and the pruning part).  Ends when no first condition is left that
    gains and whose rule is precise.

    Rules for all first conditions grow side by side: a job counts, for all of
    them, what each further condition would cover, so the number of jobs
    follows the rules' lengths.  The first in the order of gain that is
    precise is accepted."""
    values = features()

    def bin_of(f: str) -> Column:
        grid = F.array(*[F.lit(float(g)) for g in GRIDS[f]])
        return F.size(F.filter(grid, lambda g: g < values[f])).alias(f"b_{f}")

    bins = labelled.where(F.col(bad).isNotNull()).select(
        F.col(bad).alias("bad"), (F.pmod(F.xxhash64(F.col(key)), F.lit(3)) < 2).alias("grow"), *[bin_of(f) for f in GRIDS])
    # equal rows are counted once
    table = stored(bins.groupBy("bad", "grow", *[f"b_{f}" for f in GRIDS]).agg(F.count(F.lit(1)).alias("n")), "rule-bins")
    taken: list[_Growing] = []
    while True:
        first = _counts(table, taken, [_Growing([], [])])[0]
        growing = [_Growing([c], [held], done) for c, held, done in _ranked(first, min_cover)]
        while open_rules := [r for r in growing if not r.done]:
            for r, counts in zip(open_rules, _counts(table, taken, open_rules)):
                found = _ranked(counts, min_cover)
                if found:
                    c, held, r.done = found[0]
                    r.conditions.append(c)
                    r.held.append(held)
                    r.done = r.done or len(r.held) - 1 - r.best() >= PATIENCE
                else:
                    r.done = True
        accepted = next((k for r in growing if (k := r.pruned(min_cover, min_precision))), None)
        if accepted is None:
            return RuleList([r.conditions for r in taken])
        taken.append(_Growing(accepted, [], True))


def _ranked(counts: dict[str, dict[int, tuple[int, int, int, int]]], min_cover: int) -> list[tuple[Condition, tuple[int, int], bool]]:
    """The conditions that gain, by falling FOIL gain (ties: the first), each
    with the rows of the pruning part that it covers and whether it leaves no
    good row of the growing part.  A condition needs ``min_cover`` bad rows in
    both parts; of those that cover the same rows the first stands for all."""
    found = []
    for i, (f, grid) in enumerate(GRIDS.items()):
        bins = counts.get(f, {})
        everything = tuple(sum(v[k] for v in bins.values()) for k in range(4))
        p0, n0 = everything[:2]
        if not p0 or not n0:
            continue
        seen = set()
        for j in range(len(grid)):
            below = tuple(sum(v[k] for b, v in bins.items() if b <= j) for k in range(4))
            for above in (False, True):
                p, n, hp, hn = tuple(a - b for a, b in zip(everything, below)) if above else below
                if p < min_cover or hp < min_cover or n == n0 or (above, p, n, hp, hn) in seen:
                    continue
                seen.add((above, p, n, hp, hn))
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if gain > 1e-9:
                    found.append((-round(gain, 9), i, j, above, Condition(f, above, j), (hp, hn), n == 0))
    return [x[4:] for x in sorted(found, key=lambda x: x[:4])]


def labelled_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality: str = "quality", prefix: str = "q_") -> DataFrame:
    """Statistics rows that have a label, with ``bad`` (quality 0) and ``key``;
    the statistics are named ``q_`` + name whatever their ``prefix`` was.
    Only narrow statistics rows are shuffled, never texts."""
    own = [F.col(prefix + n).alias(f"q_{n}") for n in STATISTICS]
    lab = labels.select(col(id_col).alias("key"), (col(quality) == 0).alias("bad")).where("key is not null and bad is not null")
    return stats.select(col(id_col).alias("key"), *own).join(lab, "key")


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the texts that the fixed rule or the learned list
    rejects.  The statistics are computed once and written beside the
    documents, so the verdict is a scan of that table; texts are not shuffled."""
    p = fresh(docs, "q_")
    stats = stored(text_statistics(docs, text, p), "statistics")
    passed = stats.where(~base_failed(columns(p)))
    rules = learn_rules(labelled_statistics(passed, labels, id_col, prefix=p))
    return passed.where(rules.verdict(columns(p))).select(*[col(c) for c in docs.columns])
