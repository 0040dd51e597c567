"""Training-corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, token files.  Each stage calls one
operator of ``docrevise.llm`` and works on all that the stage before it kept;
its result is written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docrevise.llm import decontaminate, mixing, quality_rules, simhash, token_files
from docrevise.llm.common import stored
from docrevise.llm.queries import TOKENIZER, vocabulary_path
from docrevise.plans.registry import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the learned list rejects."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: doc_id, start, n_tokens, ids_crc32 per document."""
    return token_files.token_files(docs, vocabulary_path(TOKENIZER))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token_files", tokens)]

#: The stages need hashes and a tokenizer that SQL does not have; tests check
#: them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
