"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing, over all documents.

Each stage gets what its predecessor wrote and returns the columns of documents, the last one packed rows. All rows take part:
null ids, texts, languages and sources are values like any other (in the substring stage null ids are one document, larger
than all others), rows that repeat become one in the near-dedup stage, texts are read whole, and empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import columns, mixing, nearcopies, packing, quality, scratch, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 and more) stays: the one with the smallest id."""
    return nearcopies.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that an earlier document holds go; texts without any stay as they were."""
    return substring.apply(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating; documents taken twice are two rows."""
    return mixing.apply(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch, slot, padding."""
    return packing.pack(docs, columns.n_words(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

def _sql() -> str:
    """The stages' own SQL, each over the rows of the one before."""
    steps = [quality.APPLY_SQL, nearcopies.APPLY_SQL, substring.APPLY_SQL, mixing.APPLY_SQL, packing.ORACLE]
    over = lambda k, sql: sql if k == 0 else re.sub(r"\b(from|join) documents\b", rf"\1 stage{k - 1}", sql)
    return "with " + ", ".join(f"stage{k} as materialized ({over(k, sql)})" for k, sql in enumerate(steps)) + f" select * from stage{len(steps) - 1}"


ORACLE_SQL = _sql()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
