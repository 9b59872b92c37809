"""A training corpus from the documents table, in stages that each call one operator.

Each stage works on what the one before it kept; run() writes a stage as Parquet into
the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import catalog, decontaminate, mixing, near_copies, quality_rules, tokens
from lectern.llm.common import staged


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (SimHash links and MinHash bands, compared exactly)."""
    return near_copies.deduplicate(docs, shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document."""
    return tokens.token_files(docs, catalog.tokenizer_path(), end_id=2)


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_output),
]
#: SQL can't express fingerprints, templates and token files; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the token files' documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
