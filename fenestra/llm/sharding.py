"""Shards by Hilbert-curve order, in DataFrame functions alone.

Language, source and text length are quantised to 4 bits each by quantiles of the table's bytes in the order of the
values, so that a bucket is a range of values and minimum and maximum of a file prune; the cell's index on a
three-dimensional Hilbert curve orders the documents, so that neighbours on the curve share most of their metadata, and
each shard is a run of that order.

The law is ``bytes``. Equal texts are a group and are never cut. Groups of several rows that take more than a twentieth of
a share, fewer than twenty times the shards, are dealt first, the largest to the emptiest shard; the curve is then cut
where the room left in each shard ends. So shards differ by a twentieth of a share or the largest text at most, unless
one group alone is larger than a share.

No sum runs over one sorted list: values, groups and rows are summed in slices, and then over the slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialise

BITS, DIMS = 4, 3
#: A group of equal texts of more than 1 / GROUP_SHARE of a shard's share is dealt before the curve is cut.
GROUP_SHARE = 20
GROUP = ["h", "size", "text_crc32"]


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Index of a point with ``bits`` bits a dimension on the Hilbert curve: undo the excess rotations from the highest
    bit down, Gray-encode, then interleave the bits."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def _curve() -> list[int]:
    side = 1 << BITS
    return [hilbert_index((a, b, c)) for a in range(side) for b in range(side) for c in range(side)]


def hilbert_cell(a: Column, b: Column, c: Column) -> Column:
    """The curve index of three quantised columns, from a table of all cells that is part of the plan."""
    curve = F.expr("array(" + ",".join(map(str, _curve())) + ")")
    side = 1 << BITS
    return F.get(curve, (a * side + b) * side + c)


def _total_before(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))


def quantile_edges(rows: DataFrame, dims: list[Column], weight: Column, slices: int) -> list[list[tuple[int, str]]]:
    """(bucket, smallest value) of each dimension (strings): buckets are ranges of values of about equal weight.

    Values are dealt to ``slices`` ranges, summed there and then over the ranges; a few edges come to the driver."""
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), d.alias("v")) for i, d in enumerate(dims)]))
    values = rows.select(weight.alias("w"), named.alias("x")).groupBy("x.dim", "x.v").agg(F.sum("w").alias("w"))
    values = materialise(values.repartitionByRange(slices, "dim", "v").select("*", F.spark_partition_id().alias("slice")), "values")
    per = values.groupBy("dim", "slice").agg(F.sum("w").alias("sw"))
    per = per.select("dim", "slice", _total_before("sw", W.partitionBy("dim").orderBy("slice")).alias("before"), F.sum("sw").over(W.partitionBy("dim")).alias("all"))
    at = F.col("before") + _total_before("w", W.partitionBy("dim", "slice").orderBy("v")) + F.col("w") / 2
    bucket = F.least(F.floor(at * (1 << BITS) / F.col("all")), F.lit((1 << BITS) - 1)).cast("int")
    edges = values.join(per, ["dim", "slice"]).select("dim", "v", bucket.alias("bucket")).groupBy("dim", "bucket").agg(F.min("v").alias("v")).collect()
    return [sorted((r["bucket"], r["v"]) for r in edges if r["dim"] == i) for i in range(len(dims))]


def _bucket(value: Column, edges: list[tuple[int, str]]) -> Column:
    """The bucket of the last edge that ``value`` reaches."""
    out = F.lit(0)
    for bucket, edge in edges[1:] if edges else []:
        out = F.when(value >= F.lit(edge), F.lit(bucket)).otherwise(out)
    return out if not edges else F.greatest(out, F.lit(edges[0][0]))


def room_left(large: list[int], rest: int, shards: int) -> tuple[list[int], list[float]]:
    """Shard of each large group (the largest to the emptiest shard), and the room that is left in each shard for the
    ``rest``, so that all come as near to the same size as the groups let them."""
    load, where = [0] * shards, [0] * len(large)
    for i in sorted(range(len(large)), key=lambda i: -large[i]):
        where[i] = load.index(min(load))
        load[where[i]] += large[i]
    level, todo = 0.0, sorted(load)
    for k in range(1, shards + 1):  # fill the k emptiest up to one level
        level = (rest + sum(todo[:k])) / k
        if k == shards or level <= todo[k]:
            break
    return where, [max(0.0, level - x) for x in load]


def shard_by_curve(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and hilbert of each row.

    size: the text's UTF-8 bytes plus 1, 1 for null and empty texts (whose checksum is that of no bytes). Null languages
    and sources count as empty strings. Equal texts are a group, at the place of its smallest metadata, and all in one
    shard. Shards differ from an equal share by a twentieth of it or the largest text, unless a group is larger than a
    share. Ties on the curve go by a hash of the text; within a group by a hash of doc_id, then doc_id; repeated rows each
    get a slot. An empty table gives no rows. Shards may be empty where groups are fewer than shards. Other columns are
    not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = materialise(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), name("lang").alias("_lang"), name("source").alias("_source")), "sizes")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = max(1, math.isqrt(count))  # as many slices as rows in a slice
    dims = [F.col("_lang"), F.col("_source"), F.lpad(F.col("size").cast("string"), 20, "0")]
    edges = quantile_edges(rows, dims, F.col("size"), max(1, min(slices, 512)))
    # a third of all rows may be one group: rows of a group are dealt to parts, by their place in the table where ids repeat
    rows = rows.select("*", F.pmod(F.xxhash64("doc_id", F.col("_metadata.row_index")), F.lit(slices)).cast("int").alias("part"))
    parts = rows.groupBy(*GROUP, "part").agg(F.count("*").alias("pn"), F.min(F.struct("_lang", "_source")).alias("pm"))
    group = W.partitionBy(*GROUP)
    parts = materialise(parts.select(*GROUP, "part", _total_before("pn", group.orderBy("part")).alias("p0"), F.sum("pn").over(group).alias("n"), F.min("pm").over(group).alias("m")), "parts")
    points = [_bucket(c, e) for c, e in zip((F.col("m._lang"), F.col("m._source"), dims[2]), edges, strict=True)]
    groups = parts.where("p0 = 0").select(*GROUP, "n", (F.col("n") * F.col("size")).alias("b"), hilbert_cell(*points).alias("hilbert"), F.pmod(F.col("h"), F.lit(slices)).cast("int").alias("slice"))
    groups = materialise(groups, "groups")
    is_large = (F.col("n") > 1) & (F.col("b") * shards * GROUP_SHARE > F.lit(total))
    large = groups.where(is_large).orderBy(*GROUP).collect()  # fewer than shards * GROUP_SHARE rows, by their size
    where, room = room_left([r["b"] for r in large], total - sum(r["b"] for r in large), shards)
    groups = groups.where(~is_large)
    per = groups.groupBy("hilbert", "slice").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
    cells = per.groupBy("hilbert").agg(F.sum("sb").alias("cb"), F.sum("sn").alias("cn"))
    on_curve, in_cell, in_slice = W.orderBy("hilbert"), W.partitionBy("hilbert").orderBy("slice"), W.partitionBy("hilbert", "slice").orderBy(*GROUP)
    cells = cells.select("hilbert", _total_before("cb", on_curve).alias("cb0"), _total_before("cn", on_curve).alias("cn0"))  # 4096 rows at most
    starts = per.select("hilbert", "slice", _total_before("sb", in_cell).alias("sb0"), _total_before("sn", in_cell).alias("sn0")).join(cells, "hilbert")
    placed = groups.select("*", _total_before("b", in_slice).alias("b0"), _total_before("n", in_slice).alias("n0")).join(starts, ["hilbert", "slice"])
    # the middle of a group decides its shard
    middle = F.col("cb0") + F.col("sb0") + F.col("b0") + F.col("b") / 2
    ends = [sum(room[: k + 1]) for k in range(shards)]
    with_room = [k for k in range(shards) if room[k] > 0] or [0]
    shard = F.lit(with_room[-1])
    for k in reversed(with_room[:-1]):
        shard = F.when(middle < F.lit(ends[k]), F.lit(k)).otherwise(shard)
    placed = materialise(placed.select(*GROUP, "hilbert", shard.alias("shard"), (F.col("cn0") + F.col("sn0") + F.col("n0")).alias("first"), "n"), "placed")
    runs = {r["shard"]: (r["first"], r["n"]) for r in placed.groupBy("shard").agg(F.min("first").alias("first"), F.sum("n").alias("n")).collect()}  # a row a shard
    first = F.lit(0).cast("long")
    for k, (at, _) in runs.items():
        first = F.when(F.col("shard") == k, F.lit(at).cast("long")).otherwise(first)
    full, dealt = {k: n for k, (_, n) in runs.items()}, []
    for r, k in zip(large, where, strict=True):  # after the shard's run
        dealt.append((*(r[c] for c in GROUP), r["hilbert"], k, full.get(k, 0)))
        full[k] = full.get(k, 0) + r["n"]
    schema = "h long, size long, text_crc32 long, hilbert int, shard int, base long"
    bases = placed.select(*GROUP, "hilbert", "shard", (F.col("first") - first).alias("base")).unionByName(spark.createDataFrame(dealt, schema))
    starts = parts.select(*GROUP, "part", "p0").join(bases, GROUP)
    inside = F.row_number().over(W.partitionBy(*GROUP, "part").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    out = rows.select("doc_id", *GROUP, "part", inside.alias("i")).join(starts, [*GROUP, "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("p0") + F.col("i")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """``docs`` as Parquet in one folder a shard (shard=0 ..., or _shard=0 ... if ``docs`` has a column of that name), in
    slot order, so that files' minimum and maximum values prune. Every column and row of ``docs`` is written, repeated
    rows too; rows equal in doc_id and text lie together. An empty table writes no shard."""
    taken = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in taken else free(f"_{c}")
    folder, slot, own, crc, size = (free(c) for c in ("shard", "slot", "own_id", "own_crc", "own_size"))
    plan = shard_by_curve(docs, shards).groupBy(F.col("doc_id").alias(own), F.col("text_crc32").alias(crc), F.col("size").alias(size)).agg(F.min("shard").alias(folder), F.min("slot").alias(slot))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    same = docs["doc_id"].eqNullSafe(F.col(own)) & (F.crc32(text) == F.col(crc)) & (F.octet_length(text).cast("long") + 1 == F.col(size))
    joined = docs.join(plan, same).drop(own, crc, size)
    joined.repartitionByRange(folder, slot).sortWithinPartitions(folder, slot).drop(slot).write.partitionBy(folder).parquet(path)
