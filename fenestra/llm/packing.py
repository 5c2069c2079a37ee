"""Packing pieces of documents into training sequences: first-fit decreasing within randomised groups.

First-fit looks for the leftmost bin with room. A tournament tree over the bins' free room answers that in the
logarithm of their number: each inner node holds the larger of its two children, and the search goes left wherever the
left child has room.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: Pieces in a group, about. A group is one task's work: large enough for tight bins, small enough for any executor.
GROUP_PIECES = 16_384


class TournamentTree:
    """Free room of ``n`` bins; take(size) puts an item into the leftmost bin with that much room."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, n) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """(bin, room it had before)."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        had = room[i]
        room[i], at = had - size, i - self.leaves
        i //= 2
        while i:
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
            i //= 2
        return at, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; the sizes must be in decreasing order and at most ``capacity``."""
    tree = TournamentTree(len(sizes), capacity)
    return [(b, capacity - had) for b, had in map(tree.take, sizes)]


def pack(pieces: DataFrame, context: int = 2048, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, start, length <= context, and any other columns).

    Pieces are dealt at random (a hash of doc_id, start and the row's place in its file) to groups of about
    ``group_pieces``, so that rows without doc_id, or of one doc_id, are spread too; each group is packed alone, and its
    sequences lie gaplessly from offset 0. Ties in length go by doc_id, then start; repeated rows each get their own place.
    A null doc_id is packed like any other. An empty table gives no rows. Columns of other names come back as they are.
    """
    pieces = materialise(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    names = pieces.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        placed = np.asarray(first_fit_decreasing(pdf["length"].tolist(), context), dtype="int64").reshape(-1, 2)
        first = int(pdf["pack_group"].iloc[0]) << 32
        return pdf[names].assign(sequence_id=first + placed[:, 0], offset=placed[:, 1])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    group = F.pmod(F.xxhash64("doc_id", "start", F.col("_metadata.row_index"), F.lit(seed)), F.lit(groups))
    return pieces.withColumn("pack_group", group).groupBy("pack_group").applyInPandas(one, schema)


def pack_with_ids(pieces: DataFrame, context: int = 2048) -> DataFrame:
    """:func:`pack` for pieces that carry ``ids``: these are written once and joined to the plan, which is made without them.

    The table written knows each row by its file and its place there, so repeated rows are told apart."""
    pieces = materialise(pieces, "ids")
    keyed = pieces.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    plan = pack(keyed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "_file", "_row"), context)
    return plan.join(keyed.select("_file", "_row", "ids"), ["_file", "_row"]).drop("_file", "_row")
