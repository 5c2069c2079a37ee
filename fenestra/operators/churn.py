"""Presence churn: how often a template's presence changed over the windows that a document covers.

An element is a struct (span, transitions, indeterminate, first, last); first and last are 0 empty range, 1 unretained,
2 absent, 3 present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMPTY, UNRETAINED, ABSENT, PRESENT = range(4)
TYPE = "struct<span:int,transitions:int,indeterminate:int,first:int,last:int>"


def element(span, transitions, indeterminate, first, last) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = zip(("span", "transitions", "indeterminate", "first", "last"), (span, transitions, indeterminate, first, last), strict=True)
    return F.struct(*[lit(v).cast("int").alias(n) for n, v in parts])


def retained() -> Column:
    return element(1, 0, 0, PRESENT, PRESENT)


def unretained(span: Column, exhaustive: Column) -> Column:
    """What a template that a document doesn't name contributes: absence if the document kept everything, else unknown."""
    gone = element(span, 0, 0, ABSENT, ABSENT)
    unknown = element(span, 0, span - 1, UNRETAINED, UNRETAINED)
    return F.when(F.coalesce(span, F.lit(0)) == 0, element(0, 0, 0, EMPTY, EMPTY)).when(exhaustive, gone).otherwise(unknown)


def product(a: Column, b: Column) -> Column:
    """Earlier times later: their boundary is a transition if it is readable and presence differs."""
    readable = (a["last"] != UNRETAINED) & (b["first"] != UNRETAINED)
    moved = F.when(readable & (a["last"] != b["first"]), 1).otherwise(0)
    both = element(a["span"] + b["span"], a["transitions"] + b["transitions"] + moved, a["indeterminate"] + b["indeterminate"] + F.when(readable, 0).otherwise(1), a["first"], b["last"])
    return F.when(a["span"] == 0, b).when(b["span"] == 0, a).otherwise(both)


def _join_symbol(a: Column, b: Column) -> Column:
    return F.when((a == PRESENT) | (b == PRESENT), PRESENT).when(a == EMPTY, b).when(b == EMPTY, a).when((a == ABSENT) & (b == ABSENT), ABSENT).otherwise(UNRETAINED)


def join(a: Column, b: Column) -> Column:
    """Two views of overlapping windows: symmetric, no boundary between them."""
    return element(F.greatest(a["span"], b["span"]), a["transitions"] + b["transitions"], a["indeterminate"] + b["indeterminate"], _join_symbol(a["first"], b["first"]), _join_symbol(a["last"], b["last"]))


def fold(symbols: DataFrame, keys: list[str], order: str, symbol: str) -> DataFrame:
    """The product over the windows of a group, in order of ``order``; one element per row, ``symbol`` its presence."""
    one = F.struct(F.col(order).alias("o"), F.col(symbol).cast("int").alias("s"))
    seen = symbols.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_x"))
    base = lambda x: element(1, 0, 0, x["s"], x["s"])
    folded = F.aggregate("_x", element(0, 0, 0, EMPTY, EMPTY), lambda acc, x: product(acc, base(x)))
    return seen.select(*keys, folded.alias("churn"))
