"""License scans (operator 1): fuzzy search for short licence notices.

A notice of length m may differ in up to k edits (k grows with m).  Cut into
k + 1 pieces, at least one piece of any such match is unchanged (pigeonhole),
so the pieces are exact seeds: one multi-pattern automaton finds them all in
one pass over the whole normalised text, and only the window around a seed is
given to the regex library, whose bounded-error matching verifies the edits
and reports the span.  Numbers and the words of ``TELLING`` must be unchanged
in it: an edit there names another licence.  The base phrases (exact runs of words) are found
separately and count as places whatever the fuzzy search says.

Normalised text: A-Z lower-cased, alphanumeric words (any non-ASCII character
counts as one) joined by single spaces.  Rows are independent: no shuffle, and
a task holds one Arrow batch.

Defined cases: null and empty texts have no words, no place and score 0;
repeated rows each give their row; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.llm.common import ALNUM_BYTES, col

#: Exact phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices searched with errors (normalised spelling).
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2": "apache-2",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1": "bsl-1",
}
#: One edit is allowed per so many characters of a notice.
CHARS_PER_EDIT = 14
#: Words that, like numbers, tell one licence from another: no edit may touch them.
TELLING = frozenset({"by", "mit", "nc", "nd", "sa"})


def budget(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(notice) // chars_per_edit


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` disjoint pieces that cover the notice: (offset, piece)."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def strict(notice: str, edits: int) -> str:
    """The notice's expression with its telling words unchanged; the other
    runs share the budget, so the caller checks the sum of the edits."""
    import regex
    out, number = "", False
    for run in regex.split(r"([a-z]+|[0-9]+)", notice):
        if run.isdigit():
            # "version 1 2" is not version 2
            out += f"\0(?<![0-9]){'' if number else '(?<![0-9] )'}{run}(?![^ ])\0"
            number = True
        elif run in TELLING:
            out += f"\0(?<![^ ]){run}(?![^ ])\0"
        else:
            number = number and run == " "
            out += regex.escape(run)
    runs = out.split("\0")  # even: within the budget, odd: as it is
    return "(?b)" + "".join(x if i % 2 else f"(?:{x}){{e<={edits}}}" for i, x in enumerate(runs) if x)


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
        self.notices, self.strict = [], []
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            k = budget(notice, chars_per_edit)
            self.notices.append((notice, label, k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            self.strict.append(regex.compile(strict(notice, k)))
            for offset, piece in seeds(notice, k):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def places(self, padded: bytes) -> list[tuple[str, int]]:
        """(label, first word) of every exact phrase; ``padded`` has a space at both ends."""
        out = []
        for phrase, label in self.base:
            at = padded.find(phrase)
            while at >= 0:
                out.append((label, padded.count(b" ", 0, at)))
                at = padded.find(phrase, at + 1)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def fuzzy(self, norm: str, telling: bool = False) -> list[tuple[str, str, int, int, int, str]]:
        """(label, notice, start, end, edits, found) of the verified notices, by
        span; with ``telling`` only those whose telling words are unchanged."""
        found, tried = {}, set()
        for end, (size, where) in self.automaton.iter(norm):
            for i, offset in where:
                notice, label, k, pattern = self.notices[i]
                start = end + 1 - size - offset
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                lo, hi = max(0, start - k), start + len(notice) + k
                # one character more, so that a telling word's end is seen
                m = self.strict[i].search(norm, lo, hi + 1) if telling else pattern.search(norm, lo, hi)
                if m and sum(m.fuzzy_counts) <= k:
                    s, e = m.span()
                    found[(s, e, label)] = (label, notice, s, e, sum(m.fuzzy_counts), m.group())
        return [found[x] for x in sorted(found)]

    def scan(self, text: str):
        """n_words, places, hits of one whole text."""
        w = text.encode().translate(ALNUM_BYTES).split()
        norm = b" ".join(w)
        return len(w), self.places(b" " + norm + b" "), self.fuzzy(norm.decode(), telling=True)


_TYPE = pa.schema([
    ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("hits", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                 ("edits", pa.int64()), ("found", pa.string())])))])
_DDL = ("n_words bigint, places array<struct<label string, word bigint>>, "
        "hits array<struct<label string, notice string, start bigint, end bigint, edits bigint, found string>>")


def scan_licenses(docs: DataFrame, notices=NOTICES, base=BASE, chars_per_edit: int = CHARS_PER_EDIT,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, places (exact phrases: label, first word) and hits
    (verified notices: label, notice, start, end in the normalised text,
    edits, found) per row."""
    src = docs.select(col(id_col).alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base, chars_per_edit)
        for b in batches:
            rows = [scanner.scan(t or "") for t in b.column(1).to_pylist()]
            names = [f.name for f in _TYPE.field("hits").type.value_type]
            cols = [pa.array([r[0] for r in rows], _TYPE.field("n_words").type),
                    pa.array([[{"label": x, "word": p} for x, p in r[1]] for r in rows], _TYPE.field("places").type),
                    pa.array([[dict(zip(names, h)) for h in r[2]] for r in rows], _TYPE.field("hits").type)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *_TYPE.names])
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, {_DDL}")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract, from ``scan_licenses``."""
    def labels(*arrays: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    place, hit = F.col("places"), F.col("hits")
    best = F.array_max(F.transform(hit, lambda h: 1 - h["edits"] / F.length(h["notice"])))
    word = lambda f: f(F.transform(place, lambda p: p["word"]))
    return scanned.select(
        "doc_id", "n_words", F.size(place).cast("long").alias("n_base"), word(F.array_min).alias("first_word"),
        word(F.array_max).alias("last_word"), labels(F.transform(place, lambda p: p["label"])).alias("base_labels"),
        labels(F.transform(place, lambda p: p["label"]), F.transform(hit, lambda h: h["label"])).alias("labels"),
        F.when(F.size(place) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
