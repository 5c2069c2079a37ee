"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, further ones of any name included.

Every stage judges rows, not ids: rows without doc_id, and rows that share one, are handled by their texts. Null and empty
texts fail the quality rules. Ties go to the smallest doc_id, and to rows with a doc_id of their own. An empty table gives
empty results. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import decontam, linededup, neardup, packing, quality, tokens
from fenestra.llm.common import by_row, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so do documents of which nothing is left."""
    return by_row(docs, linededup.line_dedup_filter)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest doc_id."""
    return neardup.near_duplicate_filter(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = table(spark, sf_dir, "benchmark")
    return by_row(docs, lambda rows: decontam.decontaminate(rows, benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left, with their token ids and their place in a training sequence."""
    return packing.pack_with_ids(tokens.token_pieces(docs))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("packing", pack)]

#: Neither a perplexity model, alignments nor similarity links can be expressed in SQL that ends on whole tables:
#: tests/llm/test_pipeline_rows.py holds run() against a version that looks at all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/fenestra/{uuid.uuid4().hex}-pipeline"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
