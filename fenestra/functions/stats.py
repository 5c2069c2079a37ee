"""Statistics as expressions: entropy, divergence terms, bands, salience, octaves."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import ERROR, FATAL, ORDINAL_BINS, TERMINATOR, UNKNOWN, WARN

#: Bands of the salience ladder, by axis. Fixed values.
BAND_TERMINATOR, BAND_FATAL, BAND_ERROR, BAND_WARN, BAND_CUE = 90, 100, 80, 30, 70
#: Surprise: an edge below one in ``inverse`` of its source's observations. Fixed values.
SURPRISE = ((50, 90), (20, 75), (10, 50), (5, 25))
#: Novelty: first seen past den / num of the window. Fixed values.
NOVELTY = ((10, 9, 60), (4, 3, 40), (2, 1, 20))
#: Rarity: a share below one in ``inverse``. Fixed values.
RARITY = ((1000, 100), (100, 90), (10, 60))
RARITY_FREQUENT = 30


def entropy_bits(count: Column, total: Column) -> Column:
    """Aggregate: Shannon entropy of counts within ``total``, which may exceed their sum; 0 if there is none."""
    return F.coalesce(F.sum(F.when(count > 0, count * (F.log2(total) - F.log2(count)) / total)), F.lit(0.0))


def kl_term(p: Column, q: Column) -> Column:
    return p * F.log2(p / q)


def js_term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return 0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)


def surprise_band(edge: Column, outgoing: Column) -> Column:
    out = F.when((edge < 2) | (outgoing == 0) | edge.isNull(), 0)
    for inverse, band in SURPRISE:
        out = out.when(edge * inverse < outgoing, band)
    return out.otherwise(0)


def novelty_band(first_seen: Column, lines: Column, count: Column) -> Column:
    out = F.when((count < 2) | (lines == 0), 0)
    for num, den, band in NOVELTY:
        out = out.when(first_seen * num > lines * den, band)
    return out.otherwise(0)


def salience(level: Column, role: Column, cue: Column, count: Column, lines: Column, surprise: Column, novelty: Column) -> tuple[Column, Column]:
    """(score, axis): the largest band times rarity, and the first axis, in the ladder's order, that offers that band."""
    offers = [
        ("terminator", F.when(role == TERMINATOR, BAND_TERMINATOR).otherwise(0)),
        ("level", F.when(level == FATAL, BAND_FATAL).when(level == ERROR, BAND_ERROR).when(level == WARN, BAND_WARN).otherwise(0)),
        ("failure_cue", F.when(cue, BAND_CUE).otherwise(0)),
        ("structural_surprise", F.coalesce(surprise, F.lit(0))),
        ("novelty", F.coalesce(novelty, F.lit(0))),
    ]
    best = F.greatest(*[b for _, b in offers])
    axis = F.when(best == 0, None)
    for name, band in offers:
        axis = axis.when(band == best, name)
    rarity = F.when(lines == 0, 100)
    for inverse, factor in RARITY:
        rarity = rarity.when(count * inverse < lines, factor)
    return (best * rarity.otherwise(RARITY_FREQUENT)).cast("int"), axis


def severity(level: Column) -> Column:
    return F.when(level == UNKNOWN, -1).otherwise(level)


def octave(value: Column, bins: int = ORDINAL_BINS) -> Column:
    """Bin of a non-negative integer on the log2 ladder; 0 and 1 are bin 0."""
    return F.least(F.lit(bins - 1), F.length(F.bin(value)) - 1)


def shift_of(numerator: Column, denominator: Column) -> Column:
    """Wasserstein distance in octaves, given as a fraction, to its band."""
    return F.when(numerator >= 5 * denominator, "High").when(numerator >= 2 * denominator, "Med").when(2 * numerator >= denominator, "Low").otherwise("None")


def direction_of(signed: Column) -> Column:
    return F.when(signed < 0, "Up").when(signed > 0, "Down").otherwise("None")


def finite_or_fail(value: Column, path: str, at: Column | None = None) -> Column:
    """``value``, or an error that names its path where it is NaN or infinite; ``at`` is its index in a list, for [] in the
    path."""
    head, _, rest = path.partition("[]")
    where = F.lit(path) if at is None else F.concat(F.lit(f"{head}["), at.cast("string"), F.lit(f"]{rest}"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(where).cast("double")).otherwise(value)
