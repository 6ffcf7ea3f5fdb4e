"""A corpus pipeline: quality rules, exact duplicates, near duplicates, personal data, packing.

Each stage takes what its predecessor kept, as a table with the columns of ``documents``; the last one
returns the pieces of the packed sequences, as op3 does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outrider.llm import exact_dedup, ngram_join, packing, pii, quality
from outrider.llm.common import dropped, table, written
from outrider.llm.queries import TOKENIZER, taken_in_before


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    return quality.keep_clean(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.keep_exact(docs, taken_in_before(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect the one with the smallest id."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it taken out of the texts."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of 1024."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER, 1024, payload="crc32"), 1024)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can't express the stages after the second; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
