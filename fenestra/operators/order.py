"""Order within a window, without one task per window: ordinals and neighbours in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import KEYS

#: Positions that one task sorts.
BLOCK = 1 << 16


def with_ordinal(events: DataFrame, name: str = "ordinal", keys: list[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Adds the number of events before each one in its group, by ``seq``.

    Blocks of ``seq`` are counted first; their running totals are added to the position within the block."""
    cut = F.expr(f"seq div {block}")
    rows = events.withColumn("_block", cut)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = (rows["_block"] == starts["_b"])
    for k in keys:
        same = same & rows[k].eqNullSafe(starts[f"_{k}"])
    within = F.row_number().over(W.partitionBy(*keys, "_block").orderBy("seq")) - 1
    placed = rows.withColumn("_at", within).join(starts, same)
    return placed.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_block", "_b", "_start", "_at", *[f"_{k}" for k in keys])


def ordered(events: DataFrame) -> DataFrame:
    """Events with an ``ordinal`` that orders them; where only the order matters, ``seq`` is one, and nothing is sorted."""
    return events if "ordinal" in events.columns else events.withColumn("ordinal", F.col("seq"))


def with_previous(rows: DataFrame, value: str, back: int, keys: list[str], at: str = "_ring_at", block: int = BLOCK) -> DataFrame:
    """Adds _prev1 .. _prev``back`` of ``value`` along ``at``, a gapless position within ``keys``.

    Each block's last rows are repeated in the next block, so blocks are sorted apart and no boundary is lost."""
    spot = F.col(at)
    ghost = F.when(spot % block >= block - back, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("_ghost", F.explode(ghost)).withColumn("_block", F.expr(f"{at} div {block}") + F.col("_ghost"))
    order = W.partitionBy(*keys, "_block").orderBy(at)
    lags = {f"_prev{i}": F.lag(value, i).over(order) for i in range(1, back + 1)}
    return dealt.withColumns(lags).where("_ghost = 0").drop("_ghost", "_block")


def ranked(rows: DataFrame, name: str, order: list[Column], keys: list[str] = KEYS) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
