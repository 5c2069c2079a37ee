"""Sequences: n-grams, the transition graph, branching, surprise, the dominant path."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import KEYS, Config
from ..functions.stats import entropy_bits, surprise_band
from ..sources.shared import materialise
from .order import ordered, ranked, with_ordinal, with_previous


def ngram_events(events: DataFrame, config: Config = Config()) -> DataFrame:
    """(window, ids, ordinal): each n-gram occurrence, in rings by trace where tracing is on; spans take no part.

    Only windows with more than ``max_active_traces`` traces (0: no bound) are replayed, each as one sorted stream, with
    eviction of the ring opened first; a task holds that many rings of ``n`` ids."""
    n = config.effective_ngram_size
    rows = ordered(events).where(~F.col("is_span"))
    ring = F.col("trace_id") if config.trace_scoping_enabled else F.lit(None).cast("long")
    rows = rows.withColumn("_ring", ring).select(*KEYS, "_ring", "ordinal", "template_id")
    if not config.trace_scoping_enabled:
        return _by_lag(rows, n)
    if config.max_active_traces == 0:
        return _by_lag(rows, n)
    traces = rows.groupBy(*KEYS).agg(F.countDistinct("_ring").alias("_traces"))
    crowded = materialise(traces.where(F.col("_traces") > config.max_active_traces).select(*KEYS), "crowded")  # read three times
    if not crowded.limit(1).count():
        return _by_lag(rows, n)
    return _by_lag(rows.join(crowded, KEYS, "left_anti"), n).unionByName(_by_replay(rows.join(crowded, KEYS, "left_semi"), n, config.max_active_traces))


def _by_lag(rows: DataFrame, n: int) -> DataFrame:
    keys = [*KEYS, "_ring"]
    ringed = with_ordinal(rows.withColumn("seq", F.col("ordinal")), "_ring_at", keys)
    before = with_previous(ringed, "template_id", n - 1, keys)
    return before.where(f"_prev{n - 1} is not null").select(*KEYS, F.array(*[F.col(f"_prev{i}") for i in range(n - 1, 0, -1)], "template_id").alias("ids"), "ordinal")


def _by_replay(rows: DataFrame, n: int, cap: int) -> DataFrame:
    ordered_rows = rows.select(*KEYS, "_ring", "ordinal", "template_id").repartition(*KEYS).sortWithinPartitions(*KEYS, "ordinal")
    return ordered_rows.mapInArrow(lambda batches: _replayed(batches, n, cap), "source string, window_id long, ids array<string>, ordinal long")


def _replayed(batches: Iterator[pa.RecordBatch], n: int, cap: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of a stream (source, window_id, ring, ordinal, template_id) sorted by window and ordinal. A ring is the
    tuple of its last ids; only rings and ids become Python values, the other columns are taken by row number."""
    window, alone, rings, opened = None, (), {}, deque()
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        named = batch.column(4).dictionary_encode()
        names = named.dictionary.to_pylist()
        templates = [None if i is None else names[i] for i in named.indices.to_pylist()]
        ends = [tuple(batch.column(c)[i].as_py() for c in (0, 1)) for i in (0, size - 1)]
        # a sorted batch whose ends are in the window has no other window between them
        keys = repeat(window, size) if ends[0] == ends[1] == window else zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        found, flat = [], []
        for at, (key, ring, template) in enumerate(zip(keys, batch.column(2).to_pylist(), templates)):
            if key != window:
                window, alone, rings, opened = key, (), {}, deque()
            if ring is None:
                ids = alone = (*alone[1 - n :], template)
            else:
                held = rings.get(ring)
                if held is None:
                    if len(rings) >= cap:
                        del rings[opened.popleft()]
                    opened.append(ring)
                    ids = (template,)
                else:
                    ids = (*held[1 - n :], template)
                rings[ring] = ids
            if len(ids) == n:
                found.append(at)
                flat += ids
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, n), pa.int32()), pa.array(flat, pa.string()))
        rows = pa.array(found, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists, batch.column(3).take(rows)], names=[*KEYS, "ids", "ordinal"])


def admitted(occurrences: DataFrame, key: list[str], cap: int, keys: list[str] = KEYS) -> DataFrame:
    """(window, key, count, admitted): the first ``cap`` different keys of a window, in order of first sight, are admitted."""
    counts = occurrences.groupBy(*keys, *key).agg(F.count("*").alias("count"), F.min("ordinal").alias("_first"))
    return ranked(counts, "_seen", [F.col("_first"), *[F.col(k) for k in key]], keys).withColumn("admitted", F.col("_seen") <= cap).drop("_seen", "_first")


def ngram_counts(events: DataFrame, config: Config = Config()) -> DataFrame:
    """(window, ids, count, admitted) of every n-gram."""
    return admitted(ngram_events(events, config), ["ids"], config.max_ngram_keys)


def split(every: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(table, refused): admitted n-grams with count and conditional probability; observations refused by window."""
    refused = every.groupBy(*KEYS).agg(F.sum(F.when(~F.col("admitted"), F.col("count")).otherwise(0)).alias("dropped_ngram_observations"), F.count_if("admitted").alias("admitted_keys"))
    table = every.where("admitted").drop("admitted")
    prefix = W.partitionBy(*KEYS, F.slice("ids", 1, config.effective_ngram_size - 1))
    return table.withColumn("probability", F.col("count") / F.sum("count").over(prefix)), refused


def ngrams(events: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Both parts of ``split``, of the events' n-grams."""
    return split(ngram_counts(events, config), config)


def top_ngrams(table: DataFrame, size: int) -> DataFrame:
    return ranked(table, "rank", [F.col("count").desc(), F.col("ids")]).where(F.col("rank") <= size)


def graph(table: DataFrame) -> DataFrame:
    """Transitions between the first two ids of each n-gram, also for trigrams: (from_id, to_id, count, outgoing)."""
    edges = table.groupBy(*KEYS, F.col("ids")[0].alias("from_id"), F.col("ids")[1].alias("to_id")).agg(F.sum("count").alias("count"))
    return edges.withColumn("outgoing", F.sum("count").over(W.partitionBy(*KEYS, "from_id")))


def branching(edges: DataFrame, size: int) -> DataFrame:
    """fanout, total and entropy_bits of each source, the ``size`` of largest entropy (then total, then id)."""
    rows = edges.groupBy(*KEYS, F.col("from_id").alias("template_id")).agg(F.count("*").alias("fanout"), F.max("outgoing").alias("total"), entropy_bits(F.col("count"), F.col("outgoing")).alias("entropy_bits"))
    return ranked(rows, "rank", [F.round("entropy_bits", 12).desc(), F.col("total").desc(), F.col("template_id")]).where(F.col("rank") <= size)


def surprise(edges: DataFrame) -> DataFrame:
    """Each template's surprise band, by its most likely incoming edge (ties: the more frequent edge)."""
    likely = F.max_by(F.struct("count", "outgoing"), F.struct((F.col("count") / F.col("outgoing")).alias("p"), F.col("count").alias("c")))
    best = edges.groupBy(*KEYS, F.col("to_id").alias("template_id")).agg(likely.alias("e"))
    return best.select(*KEYS, "template_id", F.col("e.count").alias("edge_count"), F.col("e.outgoing").alias("source_outgoing"), surprise_band(F.col("e.count"), F.col("e.outgoing")).cast("int").alias("surprise"))


def dominant_path(edges: DataFrame, ranks: DataFrame, steps: int) -> DataFrame:
    """(step, template_id): the walk along each node's most frequent transition, from the busiest template.

    Ties go to the template first seen. It ends before a template already on it, at a dead end, or after ``steps``
    steps; each step is one join against the best successors."""
    ids = ranks.select(*KEYS, F.col("template_id").alias("to_id"), F.col("internal_id").alias("_i"))
    nexts = ranked(edges.join(ids, [*KEYS, "to_id"]), "_r", [F.col("count").desc(), F.col("_i")], [*KEYS, "from_id"]).where("_r = 1").select(*KEYS, F.col("from_id").alias("_at"), "to_id")
    start = ranked(ranks, "_s", [F.col("count").desc(), F.col("internal_id")]).where("_s = 1").select(*KEYS, F.array("template_id").alias("path"))
    walk = start
    for _ in range(steps):
        walk = walk.withColumn("_at", F.element_at("path", -1)).join(nexts, [*KEYS, "_at"], "left")
        fresh = F.col("to_id").isNotNull() & ~F.array_contains("path", F.col("to_id"))
        walk = walk.select(*KEYS, F.when(F.coalesce(fresh, F.lit(False)), F.concat("path", F.array("to_id"))).otherwise(F.col("path")).alias("path"))
    return walk.select(*KEYS, F.posexplode("path").alias("step", "template_id"))
