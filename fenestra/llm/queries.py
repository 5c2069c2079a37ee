"""The queries of the training-data operators, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, htmltext, linededup, neardup, packing, quality, sharding, tokens, toxicity, urlfilter
from .common import materialise, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 0.85)


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_totals(materialise(tokens.length_histogram(table(spark, sf_dir, "documents")), "histogram"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_curve(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "deleted_lines", "deleted_words", "earlier", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.length("text").cast("long").alias("n_chars_left"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = htmltext.main_text(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op9_bloom_cascade": urlfilter.JUDGE_SQL}
