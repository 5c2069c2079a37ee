"""Field histograms with a value cap, log-scale histograms of ordinals, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import DURATION_SCHEDULE, KEYS, ORDINAL_BINS, SHIFT_FLOOR
from ..functions import hll
from ..functions.stats import direction_of, entropy_bits, octave, shift_of
from .behavior import admitted
from .order import ordered
from .stats import divergences

SLOT = [*KEYS, "template_id", "param_index"]


def param_values(events: DataFrame, slots: int) -> DataFrame:
    """(window, template_id, param_index, value, original, ordinal) of the first ``slots`` parameters."""
    rows = ordered(events)
    both = F.arrays_zip(F.col("params").alias("value"), F.col("params_original" if "params_original" in rows.columns else "params").alias("original"))
    flat = rows.select(*KEYS, "template_id", "ordinal", F.posexplode(F.slice(both, 1, slots)).alias("param_index", "x"))
    return flat.select(*KEYS, "template_id", "param_index", "x.value", "x.original", "ordinal")


def field_values(events: DataFrame, slots: int, values: int) -> DataFrame:
    """Counts of each slot's first ``values`` different values, in order of arrival; later repeats of these still count."""
    return admitted(param_values(events, slots), ["value"], values, SLOT)


def field_histograms(events: DataFrame, slots: int, values: int, approximate: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """Per slot: total, kept_values, kept_count, entropy_bits (of the kept values within the total) and cardinality.
    ``counted`` are the events' field_values, where they are there already."""
    rows = field_values(events, slots, values) if counted is None else counted
    total = F.sum("count").over(W.partitionBy(*SLOT))
    kept = rows.withColumn("_n", total).groupBy(*SLOT).agg(
        F.max("_n").alias("total"), F.count_if("admitted").alias("kept_values"), F.sum(F.when(F.col("admitted"), F.col("count")).otherwise(0)).alias("kept_count"),
        entropy_bits(F.when(F.col("admitted"), F.col("count")), F.col("_n")).alias("entropy_bits"))
    if not approximate:
        return kept
    # the sketch sees values as they came, before repair and caps; each is hashed once
    seen = hll.cardinality(param_values(events, slots).select(*SLOT, "original").distinct(), SLOT, "original")
    return kept.join(seen.withColumnRenamed("estimate", "cardinality"), SLOT)


def histogram_divergence(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence of slots on both sides: frames of (keys, value, count, total)."""
    both = previous.select(*keys).distinct().join(current.select(*keys).distinct(), keys)
    return divergences(previous.join(both, keys, "left_semi"), current.join(both, keys, "left_semi"), keys, ["value"]).select(*keys, "js_divergence")


def ordinal_bins(events: DataFrame) -> DataFrame:
    """(window, template_id, component, field_name, schedule, bin, n): the first schedule a field shows is the one kept."""
    rows = ordered(events)
    flat = rows.select(*KEYS, "template_id", "component", "ordinal", F.inline("ordinals"))
    field = [*KEYS, "template_id", "field_name"]
    first = flat.groupBy(*field).agg(F.min_by("schedule", "ordinal").alias("_s"))
    kept = flat.join(first, field).where("schedule = _s and value >= 0")
    return kept.groupBy(*field, "component", "schedule", octave(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def ordinal_histograms(bins: DataFrame) -> DataFrame:
    """Per template and field: total and the 48 counts."""
    per = bins.groupBy(*KEYS, "template_id", "field_name", "schedule", "bin").agg(F.sum("n").alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    out = per.groupBy(*KEYS, "template_id", "field_name", "schedule").agg(F.sum("n").alias("total"), held.alias("_m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(ORDINAL_BINS - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0).cast("long")))
    return out.withColumn("counts", counts).drop("_m")


def component_durations(bins: DataFrame) -> DataFrame:
    """Duration counts by component: (window, component, bin, n). Other schedules' bins mean something else."""
    return bins.where((F.col("schedule") == DURATION_SCHEDULE) & F.col("component").isNotNull()).groupBy(*KEYS, "component", "bin").agg(F.sum("n").alias("n"))


def w1_shift(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Exact Wasserstein-1 drift of (keys, bin, n) frames: octaves, shift and direction, where both sides have the floor
    of 32 samples. Sums are decimals, so no rounding decides a band."""
    d = "decimal(38,0)"
    both = previous.select(*keys, "bin", F.col("n").alias("a"), F.lit(0).alias("b")).unionAll(current.select(*keys, "bin", F.lit(0).alias("a"), F.col("n").alias("b")))
    bins = both.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole, run = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cdf = bins.select(*keys, "bin", F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"), F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"), F.lead("bin").over(whole.orderBy("bin")).alias("nxt"))
    cdf = cdf.where(F.least("na", "nb") >= SHIFT_FLOOR)
    # counts stay the same up to the next bin that either side has
    wide = (F.coalesce("nxt", F.col("bin") + 1) - F.col("bin")).cast("decimal(4,0)")
    gap = (F.col("cb").cast("decimal(17,0)") * F.col("na").cast("decimal(17,0)") - F.col("ca").cast("decimal(17,0)") * F.col("nb").cast("decimal(17,0)")) * wide
    sums = cdf.groupBy(*keys).agg(F.sum(F.abs(gap)).cast(d).alias("num"), F.sum(gap).cast(d).alias("signed"), F.max("na").alias("previous_total"), F.max("nb").alias("current_total"))
    den = (F.col("previous_total").cast("decimal(17,0)") * F.col("current_total").cast("decimal(17,0)")).cast(d)
    return sums.select(*keys, "previous_total", "current_total", (F.col("num").cast("double") / den.cast("double")).alias("octaves"), shift_of(F.col("num"), den).alias("shift"), direction_of(F.col("signed")).alias("direction"))
