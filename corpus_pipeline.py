"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the documents of the next one.

Defined results: a null or empty text has no words, so the quality rules reject it; null ids are documents like any other; rows with equal ids
are told apart by their texts, and of equal rows one stays; ties among near duplicates go to the smallest id, a null one last;
texts are used whole; further columns pass through all stages but the last; an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrove.llm import bpe, mixing, ngram_join, quality, secrets
from tallgrove.llm.common import table, written

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("secret_scans", secrets.stage),
    ("source_mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL cannot express the byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenised corpus of the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
