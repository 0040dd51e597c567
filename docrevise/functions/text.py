"""Column expressions that reproduce Python string semantics on the JVM.

Positions returned here are 0-based like Python's ``str.find``; Spark's own
``locate``/``substring`` are 1-based and are only used inside these helpers.
All patterns are written so that Java regex and RE2 (the DuckDB oracle) read
them the same way: ``\\x{..}`` escapes, ``\\p{Nd}`` digits, ``\\A``/``\\z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WS", "DIGIT", "py_strip", "py_split", "window_text",
    "is_upper", "html_escape", "quote_regex", "lookahead_regex", "str_array",
    "div", "col_or_lit", "sql_str", "sql_let", "sql_strip", "sql_running",
]

# Python's str.isspace() set (also what re's \s and str.split() use).
WS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters, for trimming.
WS_CHARS = "".join(chr(i) for i in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Python's \d for str patterns: any decimal digit.
DIGIT = r"\p{Nd}"


def col_or_lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading and trailing whitespace (Python's set)."""
    return F.btrim(c, F.lit(WS_CHARS))


def py_split(c: Column) -> Column:
    """``str.split()`` without arguments: whitespace runs, no empty items."""
    s = py_strip(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+", -1))


def window_text(text: Column, pos: Column, length: Column, before: int, after: int) -> Column:
    """``text[max(0, pos-before):min(len(text), pos+length+after)]``."""
    start = F.greatest(pos - F.lit(before), F.lit(0))
    end = F.least(F.length(text), pos + length + F.lit(after))
    return F.call_function("substring", text, start + 1, F.greatest(end - start, F.lit(0)))


def is_upper(c: Column) -> Column:
    """``str.isupper()``: no lower-case letter and at least one cased letter."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def html_escape(c: Column) -> Column:
    """``html.escape(s, quote=True)``: ``&`` first, then ``< > " '``."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


def quote_regex(c: Column) -> Column:
    """A regex matching the literal value of ``c`` (safe for ``\\E`` inside)."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def lookahead_regex(c: Column) -> Column:
    """Zero-width regex matching wherever the literal ``c`` starts (overlaps too)."""
    return F.concat(F.lit("(?="), quote_regex(c), F.lit(")"))


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def div(a: Column, b) -> Column:
    """Floor division for non-negative integers (Python ``//``)."""
    return F.floor(a / col_or_lit(b)).cast("long")


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text that binds ``value`` to ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_strip(c: str) -> str:
    """``py_strip`` as SQL text."""
    pattern = sql_str(rf"\A{WS}+|{WS}+\z")
    return f"regexp_replace({c}, {pattern}, '')"


def sql_running(values: str, merge: str, start: str, step: int = 256) -> str:
    """SQL text: the merge of all bigint values before each one, in time linear
    in the array: ``array_append`` copies, so the result grows in groups of
    ``step``.  ``merge`` names the value so far ``_y.v`` and the next ``_n``."""
    inner = (f"aggregate(_group, named_struct('v', _a.v, 'out', cast(array() as array<bigint>)), "
             f"(_y, _n) -> named_struct('v', cast({merge} as bigint), 'out', array_append(_y.out, _y.v)))")
    groups = f"transform(sequence(0, cast(floor((greatest(size({values}), 1) - 1) / {step}) as int)), _g -> slice({values}, _g * {step} + 1, {step}))"
    fold = sql_let(inner, "_r", "named_struct('v', _r.v, 'out', array_append(_a.out, _r.out))")
    return (f"flatten(aggregate({groups}, named_struct('v', cast({start} as bigint), 'out', cast(array() as array<array<bigint>>)), "
            f"(_a, _group) -> {fold}, _a -> _a.out))")
