"""Template statistics of each window: counts, labels, ranks, entropy, tail, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import KEYS, LEVELS, ROLES, UNKNOWN
from ..functions.stats import entropy_bits, js_term, kl_term
from .order import ordered, ranked, with_ordinal


def template_stats(events: DataFrame, places: bool = True) -> DataFrame:
    """One row per window and template: count, first_seen, level, level_declared, role, component, echoed, template_str.

    Two aggregations, both combined map-side: first by component too, then over components. Ties: the more severe level
    (UNKNOWN is the least), the larger role, the smaller component. Without ``places``, first_seen is only an order, and no
    event needs to be numbered.
    """
    rows = events if "ordinal" in events.columns else with_ordinal(events) if places else ordered(events)
    levels, roles = range(len(LEVELS)), range(len(ROLES))
    per = rows.groupBy(*KEYS, "template_id", "component").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("first_seen"), F.bool_and("echoed_source").alias("echoed"), F.min("template_str").alias("template_str"),
        *[F.count_if(F.col("level") == k).alias(f"l{k}") for k in levels], *[F.count_if((F.col("level") == k) & F.col("declared_level")).alias(f"d{k}") for k in levels],
        *[F.count_if(F.col("role") == k).alias(f"r{k}") for k in roles])
    located = F.when(F.col("component").isNotNull(), F.struct((-F.col("n")).alias("c"), F.col("component").alias("name")))
    agg = per.groupBy(*KEYS, "template_id").agg(
        F.sum("n").alias("count"), F.min("first_seen").alias("first_seen"), F.bool_and("echoed").alias("echoed"), F.min("template_str").alias("template_str"),
        F.min(located).alias("_c"), *[F.sum(f"{p}{k}").alias(f"{p}{k}") for p, ks in (("l", levels), ("d", levels), ("r", roles)) for k in ks])
    best_level = F.greatest(*[F.struct(F.col(f"l{k}").alias("n"), F.lit(-1 if k == UNKNOWN else k).alias("s"), (F.col(f"d{k}") > 0).alias("d")) for k in levels])
    best_role = F.greatest(*[F.struct(F.col(f"r{k}").alias("n"), F.lit(k).alias("r")) for k in roles])
    out = agg.withColumn("_l", best_level).withColumn("_r", best_role)
    level = F.when(F.col("_l.s") < 0, UNKNOWN).otherwise(F.col("_l.s"))
    return out.select(*KEYS, "template_id", "template_str", "count", "first_seen", level.alias("level"), F.col("_l.d").alias("level_declared"), F.col("_r.r").alias("role"), F.col("_c.name").alias("component"), "echoed")


def window_totals(stats: DataFrame) -> DataFrame:
    """lines, unique_templates and entropy_bits of each window, over all its templates."""
    total = F.sum("count").over(W.partitionBy(*KEYS))
    rows = stats.select(*KEYS, "count", total.alias("_n"))
    return rows.groupBy(*KEYS).agg(F.sum("count").alias("lines"), F.count("*").alias("unique_templates"), entropy_bits(F.col("count"), F.col("_n")).alias("entropy_bits"))


def with_rank(stats: DataFrame) -> DataFrame:
    """Adds rank (count, then id), internal_id (order of first sight) and lines."""
    rows = ranked(stats, "rank", [F.col("count").desc(), F.col("template_id")])
    rows = ranked(rows, "internal_id", [F.col("first_seen"), F.col("template_id")]).withColumn("internal_id", F.col("internal_id") - 1)
    return rows.withColumn("lines", F.sum("count").over(W.partitionBy(*KEYS)))


def top_k(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.where(F.col("rank") <= k).withColumn("frequency", F.col("count") / F.col("lines"))


def tail(ranks: DataFrame, k: int, reservoir: DataFrame | None = None) -> DataFrame:
    """tail_count, tail_unique and, for windows with a tail, tail_entropy_bits over its own mass and tail_max_rate."""
    rest = ranks.where(F.col("rank") > k)
    if reservoir is not None:
        rest = rest.join(reservoir.select(*KEYS, "template_id"), [*KEYS, "template_id"], "left_anti")
    mass = F.sum("count").over(W.partitionBy(*KEYS))
    some = rest.withColumn("_m", mass).groupBy(*KEYS).agg(
        F.sum("count").alias("tail_count"), F.count("*").alias("tail_unique"), entropy_bits(F.col("count"), F.col("_m")).alias("tail_entropy_bits"), (F.max("count") / F.max("lines")).alias("tail_max_rate"))
    windows = ranks.select(*KEYS).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tail_count", "tail_unique")}
    return windows.join(some, KEYS, "left").withColumns(zero)


def spine(stats: DataFrame) -> DataFrame:
    """Every window id from a source's first to its last, also those without events."""
    ends = stats.groupBy("source").agg(F.min("window_id").alias("lo"), F.max("window_id").alias("hi"))
    return ends.select("source", F.explode(F.sequence("lo", "hi")).alias("window_id"))


def divergences(previous: DataFrame, current: DataFrame, keys: list[str], key: list[str]) -> DataFrame:
    """kl_divergence and js_divergence, in bits, of (``keys``, ``key``, count, total) frames, by ``keys``.

    Laplace-smoothed by one over the union of their keys; totals may exceed the counts' sums (truncated lists). Rows of
    one side only count 0 on the other. Groups that one frame lacks have no row. One union and two shuffles; no join.
    """
    side = lambda f, own, other: f.select(*keys, *key, F.col("count").alias(own[0]), F.col("total").alias(own[1]), *[F.lit(None).cast("long").alias(c) for c in other])
    rows = side(previous, ("a", "na"), ("b", "nb")).unionByName(side(current, ("b", "nb"), ("a", "na")))
    group = W.partitionBy(*keys)
    both = rows.groupBy(*keys, *key).agg(*[F.max(c).alias(c) for c in ("a", "b", "na", "nb")])
    both = both.withColumns({"na": F.max("na").over(group), "nb": F.max("nb").over(group), "k": F.count("*").over(group)}).where("na > 0 and nb > 0")
    pc = (F.coalesce("b", F.lit(0)) + 1) / (F.col("nb") + F.col("k"))
    pp = (F.coalesce("a", F.lit(0)) + 1) / (F.col("na") + F.col("k"))
    return both.withColumns({"p": pc, "q": pp}).groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.sum(kl_term(F.col("p"), F.col("q")))).alias("kl_divergence"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(js_term(F.col("p"), F.col("q"))))).alias("js_divergence"),
        F.count_if(F.col("a").isNull()).alias("new_templates"), F.count_if(F.col("b").isNull()).alias("vanished_templates"))


def stability(stats: DataFrame) -> DataFrame:
    """Each window against the one before it on the spine: a window after an empty one has no row."""
    total = F.sum("count").over(W.partitionBy(*KEYS)).alias("total")
    rows = stats.select(*KEYS, "template_id", "count", total)
    previous = rows.withColumn("window_id", F.col("window_id") + 1)
    out = divergences(previous, rows, KEYS, ["template_id"])
    return out.withColumn("stability_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("js_divergence"))))
