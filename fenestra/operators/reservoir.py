"""The salience reservoir: rare but important templates below the top-k cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import KEYS, TERMINATOR, Config
from ..functions.stats import novelty_band, salience
from ..functions.text import failure_cue, is_failure
from .order import ranked


def candidates(ranks: DataFrame, surprise: DataFrame, k: int) -> DataFrame:
    """Templates below the cut with a positive salience, and its parts."""
    rest = ranks.where(F.col("rank") > k).join(surprise.select(*KEYS, "template_id", "surprise"), [*KEYS, "template_id"], "left")
    rest = rest.withColumns({"surprise": F.coalesce("surprise", F.lit(0)), "novelty": novelty_band(F.col("first_seen"), F.col("lines"), F.col("count")).cast("int")})
    cue = ~F.col("echoed") & failure_cue(F.col("template_str"))
    score, axis = salience(F.col("level"), F.col("role"), cue, F.col("count"), F.col("lines"), F.col("surprise"), F.col("novelty"))
    return rest.withColumns({"salience": score, "retention_axis": axis}).where("salience > 0")


def reservoir(found: DataFrame, config: Config) -> DataFrame:
    """Admission in two phases, each by salience, then id: an error reserve first, exempt from the cap per kind of (role,
    level); then everything else under that cap. slot is the place in the reservoir."""
    size, cap = config.reservoir_size, config.reservoir_per_kind_cap
    reserve = min(config.reservoir_error_reserve, size)
    order = [F.col("salience").desc(), F.col("template_id")]
    error = (F.col("role") == TERMINATOR) | is_failure(F.col("level"))
    rows = ranked(found.withColumn("_error", error), "_e", order, [*KEYS, "_error"])
    rows = rows.withColumn("_phase", F.when(F.col("_error") & (F.col("_e") <= reserve), 1).otherwise(2))
    rows = ranked(rows, "_kind", order, [*KEYS, "_phase", "role", "level"])
    if cap > 0:
        rows = rows.where((F.col("_phase") == 1) | (F.col("_kind") <= cap))
    rows = ranked(rows, "slot", [F.col("_phase"), *order]).where(F.col("slot") <= size)
    return rows.withColumn("frequency", F.col("count") / F.col("lines")).drop("_error", "_e", "_phase", "_kind")
