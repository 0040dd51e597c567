"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrevise.session import checkpoint_path

#: White space between words in the contracts: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: ASCII characters that separate alphanumeric words (after lower-casing).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: bytes.translate tables: A-Z to a-z; the second also blanks separators.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_BYTES = bytes(LOWER_BYTES[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return checkpoint_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is
    cut, nothing is computed twice, later scans read only their columns and
    Spark knows the size.  Survives lost executors (the folder is shared)."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on pure ASCII text and
    is much cheaper than ``translate``."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def words(c: Column, separator: str) -> Column:
    return F.array_remove(F.split(c, separator, -1), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (lambda
    functions get no common-subexpression elimination)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def col(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, prefix: str) -> str:
    """A prefix that starts no column name of ``df`` (names ignore case)."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix
