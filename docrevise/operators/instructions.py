"""Instruction analysis (one row per request): I1-I8.

Every function takes a DataFrame with ``job_id`` and ``instruction`` and works
with built-in regex and array functions, so the work stays in the JVM and
scales with the number of requests.  Array-valued ``*_array`` helpers return
columns that can be used in-row; the DataFrame functions explode them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrevise.functions import constants as K
from docrevise.functions.text import DIGIT, WS, py_split, py_strip, str_array

# Patterns (Java syntax, also valid RE2).
DOUBLE_QUOTED = r'"([^"]*)"'
SINGLE_QUOTED = r"'([^']*)'"
ANY_QUOTED = r"""['"]([^'"]+)['"]"""
PART_SEPARATOR = rf"\n|{DIGIT}+\.|{WS}*-{WS}*"
_ROLES = "|".join(K.COMPANY_ROLES)
_SUFFIXES = "|".join(K.COMPANY_SUFFIXES)
COMPANY_PATTERNS = [
    rf"""(?d)(?:{_ROLES}){WS}+Name.*?['"]([^'"]+)['"]""",
    rf"""(?d)[Cc]hange{WS}+(?:the{WS}+)?([^'"].*?(?:{_SUFFIXES}))[^'"].*?from""",
    rf"""(?d)[Uu]pdate{WS}+(?:the{WS}+)?([^'"].*?(?:{_SUFFIXES}))[^'"].*?from""",
]
REPLACEMENT_PAIR = rf"""(?:from{WS}+)?['"]([^'"]+)['"]{WS}+to{WS}+['"]([^'"]+)['"]"""


def _extract_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


# ---------------------------------------------------------------- I1 quoted spans
def quoted_spans_array(instr: Column) -> Column:
    """All ``"..."`` spans, then all ``'...'`` spans."""
    return F.concat(_extract_all(instr, DOUBLE_QUOTED), _extract_all(instr, SINGLE_QUOTED))


def quoted_spans(req: DataFrame, min_len: int = K.MIN_QUOTED_LEN) -> DataFrame:
    """All ``"..."`` spans, then all ``'...'`` spans, longer than ``min_len``.

    ``ord`` is the position among all spans before the length filter is
    applied, so that it matches the reference's list order.
    """
    return (req.select("job_id", F.posexplode(quoted_spans_array(F.col("instruction"))).alias("ord", "text"))
            .where(F.length("text") > min_len))


# ---------------------------------------------------------------- I2 parts
def instruction_parts(req: DataFrame, min_len: int = K.MIN_PART_LEN) -> DataFrame:
    """Split on newline, ``\\d+.`` or a dash with blanks; strip; keep >= min_len."""
    parts = F.split(F.col("instruction"), PART_SEPARATOR, -1)
    return (req.select("job_id", F.posexplode(parts).alias("part_ord", "raw"))
            .select("job_id", "part_ord", py_strip(F.col("raw")).alias("part"))
            .where(F.length("part") >= min_len))


# ---------------------------------------------------------------- I3 action phrases
def action_phrases(parts: DataFrame, verbs=None) -> DataFrame:
    """For each part and verb (in order): the first three words after the
    verb's first occurrence (case-insensitive), with the reference's guards."""
    verbs = verbs or K.ACTION_VERBS
    lp = F.lower(F.col("part"))
    x = parts.select("job_id", "part_ord", "part", F.posexplode(str_array(verbs)).alias("verb_ord", "verb"))
    vpos = F.call_function("locate", F.col("verb"), lp) - 1
    x = x.withColumn("vpos", vpos).where(
        (F.col("vpos") >= 0) & (F.col("vpos") + F.length("verb") + 1 < F.length("part")))
    phrase = py_strip(F.call_function("substring", F.col("part"), F.col("vpos") + F.length("verb") + 1))
    x = x.withColumn("phrase", phrase).where(F.length("phrase") > 3)
    search = F.array_join(F.slice(py_split(F.col("phrase")), 1, 3), " ")
    return (x.withColumn("search", search).where(F.length("search") > 3)
            .select("job_id", "part_ord", "verb_ord", "verb", "phrase", "search"))


# ---------------------------------------------------------------- I4 field mentions
def field_mentions(req: DataFrame, fields=None) -> DataFrame:
    """I4: fields whose text occurs in the lower-cased instruction (substring)."""
    fields = fields or K.CONTRACT_FIELDS
    x = req.select("job_id", "instruction", F.posexplode(str_array(fields)).alias("field_ord", "field"))
    return (x.where(F.call_function("contains", F.lower("instruction"), F.col("field")))
            .select("job_id", "field_ord", "field"))


# ---------------------------------------------------------------- I5-I7 entities
def quoted_entities_array(instr: Column) -> Column:
    return F.filter(_extract_all(instr, ANY_QUOTED), lambda s: F.length(s) > 3)


def company_entities_array(instr: Column) -> Column:
    found = [F.transform(_extract_all(instr, p), lambda s: py_strip(s)) for p in COMPANY_PATTERNS]
    return F.filter(F.concat(*found), lambda s: F.length(s) > 3)


def key_entities_array(instr: Column) -> Column:
    """Unique entities, first-occurrence order, quoted ones first."""
    return F.array_distinct(F.concat(quoted_entities_array(instr), company_entities_array(instr)))


def quoted_entities(req: DataFrame) -> DataFrame:
    """Text between two quote marks of any kind, longer than 3."""
    return req.select("job_id", F.posexplode(quoted_entities_array(F.col("instruction"))).alias("ord", "entity"))


def company_entities(req: DataFrame) -> DataFrame:
    """Company names from the three role / change / update patterns."""
    return req.select("job_id", F.posexplode(company_entities_array(F.col("instruction"))).alias("ord", "entity"))


def key_entities(req: DataFrame) -> DataFrame:
    """(job_id, ent_ord, entity), duplicates removed, order kept."""
    return req.select("job_id", F.posexplode(key_entities_array(F.col("instruction"))).alias("ent_ord", "entity"))


# ---------------------------------------------------------------- I8 replacement pairs
def replacement_pairs_array(instr: Column) -> Column:
    olds = _extract_all(instr, REPLACEMENT_PAIR, 1)
    news = _extract_all(instr, REPLACEMENT_PAIR, 2)
    return F.arrays_zip(olds.alias("old"), news.alias("new"))


def replacement_pairs(req: DataFrame) -> DataFrame:
    """I8: ``from 'X' to 'Y'`` / ``'X' to 'Y'`` pairs, in order."""
    return (req.select("job_id", F.posexplode(replacement_pairs_array(F.col("instruction"))).alias("ord", "p"))
            .select("job_id", "ord", F.col("p.old").alias("old"), F.col("p.new").alias("new")))
