"""HyperLogLog with 2 ** 14 registers over FNV-1a hashes with a final mix, as SQL over bytes.

Wrap-around products need ANSI mode off: :func:`hash64` multiplies in two 32-bit halves instead, so it works in either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

P, M = 14, 1 << 14
#: FNV-1a offset and prime, and the multipliers of the final mix. Fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _times(h: str, k: int) -> str:
    """SQL for the low 64 bits of h * k: cross products of 32-bit halves, the upper ones kept to 32 bits before the shift."""
    lo, hi = k & 0xFFFFFFFF, k >> 32
    a, b = f"({h} & 4294967295L)", f"shiftrightunsigned({h}, 32)"

    def low32(x: str, y: int) -> str:
        y0, y1 = y & 0xFFFF, y >> 16
        return f"((({x} * {y0}L) + shiftleft(({x} * {y1}L) & 65535L, 16)) & 4294967295L)"

    def high32(x: str, y: int) -> str:
        y0, y1 = y & 0xFFFF, y >> 16
        return f"shiftrightunsigned({x} * {y1}L + shiftrightunsigned({x} * {y0}L, 16), 16)"

    upper = f"(({high32(a, lo)} + {low32(a, hi)} + {low32(b, lo)}) & 4294967295L)"
    return f"(shiftleft({upper}, 32) | {low32(a, lo)})"


def hash64(name: str) -> Column:
    """The 64-bit hash of a string column's bytes, as a long."""
    bytes_ = f"transform(sequence(1, greatest(octet_length({name}), 1)), i -> cast(conv(hex(substr(cast({name} as binary), i, 1)), 16, 10) as bigint))"
    step = _times("(acc ^ x)", FNV_PRIME)
    fold = f"aggregate(CASE WHEN octet_length({name}) = 0 THEN array() ELSE {bytes_} END, {_signed(FNV_OFFSET)}L, (acc, x) -> {step})"
    mix = lambda h: f"({h} ^ shiftrightunsigned({h}, 33))"
    one = f"transform(array({fold}), h -> {mix('h')})"
    two = f"transform({one}, h -> {_times('h', MIX_1)})"
    three = f"transform(transform({two}, h -> {mix('h')}), h -> {_times('h', MIX_2)})"
    return F.expr(f"transform({three}, h -> {mix('h')})[0]")


def registers(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, idx, rank): the registers that are set."""
    h = values.select(*keys, hash64(name).alias("h"))
    rest = F.shiftleft("h", P)
    rank = F.when(rest == 0, 64 - P + 1).otherwise(64 - F.length(F.bin(rest)) + 1)
    return h.groupBy(*keys, F.shiftrightunsigned("h", 64 - P).alias("idx")).agg(F.max(rank).alias("rank"))


def estimate(registers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values by the registers; linear counting where few are set."""
    alpha = 0.7213 / (1 + 1.079 / M)
    agg = registers.groupBy(*keys).agg(F.count("*").alias("set"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    raw = F.lit(alpha * M * M) / (F.col("s") + (M - F.col("set")))
    zeros = M - F.col("set")
    linear = F.lit(float(M)) * F.log(F.lit(float(M)) / zeros)
    return agg.select(*keys, F.floor(F.when((raw < 2.5 * M) & (zeros > 0), linear).otherwise(raw)).cast("long").alias("estimate"))


def cardinality(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    return estimate(registers(values, keys, name), keys)
