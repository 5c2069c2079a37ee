"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import materialise, shared_dir

#: Rows and bytes of one Arrow batch at most (a single row may be larger): bounds a Python worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Row ids from here on stand for rows that their doc_id does not tell apart.
SHARED_IDS = 1 << 62
__all__ = ["ARROW_BYTES", "ARROW_ROWS", "SHARED_IDS", "by_row", "materialise", "shared_dir", "small_batches", "table", "worker_state"]
T = TypeVar("T")


_STATE: dict[str, object] = {}


def worker_state(key: str, make: Callable[[], T], most: int = 1) -> T:
    """What a Python worker keeps from task to task, such as a cache of words; only the ``most`` last made are kept."""
    if key not in _STATE:
        while len(_STATE) >= most:
            del _STATE[next(iter(_STATE))]
        _STATE[key] = make()
    return _STATE[key]  # type: ignore[return-value]


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch bounds, which Spark reads when a plan runs; a caller's smaller ones stay."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs`` with an id for every row in place of doc_id, which comes back in what the stage keeps.

    A doc_id of one row is that row's id. Rows without doc_id, or with one that other rows have too, get an id from
    ``SHARED_IDS`` on by a hash of all their doc_id, lang, source and text, so equal rows share one and come after all
    others."""
    prefix = "_"
    while any(c.startswith(f"{prefix}row_") for c in docs.columns):
        prefix += "_"
    name, key, known, again = (f"{prefix}row_{x}" for x in ("doc_id", "key", "known", "again"))
    counted = docs.groupBy(F.col("doc_id").cast("long").alias(known)).agg(F.count("*").alias(again)).where(f"{known} is null or {again} > 1")
    repeated = materialise(counted.select(known), "repeated")
    hashed = F.lit(SHARED_IDS) + F.shiftrightunsigned(F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "lang", "source", "text")]), 2)
    rows = docs.withColumn(name, F.col("doc_id"))
    if repeated.limit(1).count():
        seen = repeated.where(F.col(known).isNotNull()).select(known, F.lit(True).alias(again))
        rows = rows.withColumn(key, F.col("doc_id").cast("long")).join(seen, F.col(key) == F.col(known), "left")
        rows = rows.withColumn("doc_id", F.when(F.col(key).isNull() | F.coalesce(again, F.lit(False)), hashed).otherwise(F.col(key))).drop(key, known, again)
    out = stage(rows)
    return out.withColumn("doc_id", F.col(name)).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

