"""Span trees and services: parents, links, edges with their caps."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import KEYS
from ..sources.shared import materialise
from .behavior import admitted
from .order import ranked


def active_spans(spans: DataFrame, cap: int) -> DataFrame:
    """(window, span_id, template_id, component): the ``cap`` span ids of a window that were inserted last; 0 keeps all.

    An id seen again while it is held keeps its place and its first record; one that has been evicted enters anew. Only
    windows over the cap in which ids come again are replayed, each as one sorted stream of which a task holds ``cap`` ids."""
    first = spans.groupBy(*KEYS, "span_id").agg(F.min("seq").alias("_first"), F.min_by(F.struct("template_id", "component"), "seq").alias("_x"), F.count("*").alias("_n"))
    if cap == 0:
        return first.select(*KEYS, "span_id", "_x.*")
    again = first.groupBy(*KEYS).agg(F.count("*").alias("_ids"), F.max("_n").alias("_most")).where((F.col("_ids") > cap) & (F.col("_most") > 1)).select(*KEYS)
    again = materialise(again, "windows")
    plain = ranked(first.join(again, KEYS, "left_anti"), "_r", [F.col("_first").desc()]).where(F.col("_r") <= cap).select(*KEYS, "span_id", "_x.*")
    rows = spans.join(again, KEYS, "left_semi").select(*KEYS, "seq", "span_id", "template_id", "component")
    ordered_rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    return plain.unionByName(ordered_rows.mapInArrow(lambda batches: _held(batches, cap), plain.schema))


def _held(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """The ids that each window of a sorted stream holds at its end."""
    window, held = None, OrderedDict()

    def out() -> pa.RecordBatch:
        rows = [(*window, i, *x) for i, x in held.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*KEYS, "span_id", "template_id", "component"])

    for batch in batches:
        for source, w, _, span_id, template, component in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (source, w) != window:
                if held:
                    yield out()
                window, held = (source, w), OrderedDict()
            if span_id not in held:
                if len(held) >= cap:
                    held.popitem(last=False)
                held[span_id] = (template, component)
    if held:
        yield out()


def resolve(children: DataFrame, spans: DataFrame) -> DataFrame:
    """Each pending child edge (window, seq, parent_span_id, template_id, component) with its parent, null for orphans."""
    parents = spans.select(*KEYS, F.col("span_id").alias("parent_span_id"), F.col("template_id").alias("parent_template"), F.col("component").alias("parent_component"), F.lit(True).alias("found"))
    return children.join(parents, [*KEYS, "parent_span_id"], "left")


def link_edges(spans: DataFrame) -> DataFrame:
    """Span links as pending edges: the linking span calls, its target is called."""
    return spans.select(*KEYS, "seq", "template_id", "component", F.explode("linked_span_ids").alias("parent_span_id"))


def orphans(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(*KEYS).agg(F.count_if(F.col("found").isNull()).alias("orphan_parent_edges"), F.count_if("found").alias("resolved_edges"))


def service_edges(resolved: DataFrame, links: DataFrame | None, cap: int) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped): caller, callee and count between different, named components, the heaviest ``cap`` of a window."""
    calls = resolved.where("found").select(*KEYS, F.col("parent_component").alias("caller"), F.col("component").alias("callee"))
    if links is not None:
        calls = calls.unionAll(links.where("found").select(*KEYS, F.col("component"), F.col("parent_component")))
    edges = calls.where("caller is not null and callee is not null and caller != callee").groupBy(*KEYS, "caller", "callee").agg(F.count("*").alias("count"))
    rows = ranked(edges, "_r", [F.col("count").desc(), F.col("caller"), F.col("callee")])
    return rows.where(F.col("_r") <= cap).drop("_r"), rows.groupBy(*KEYS).agg(F.count_if(F.col("_r") > cap).alias("dropped_edges"))


def span_edges(resolved: DataFrame, size: int, key_cap: int) -> tuple[DataFrame, DataFrame]:
    """(edges, refused): template pairs along parent edges, admitted in order of arrival, the ``size`` most frequent."""
    pairs = resolved.where("found").select(*KEYS, "parent_template", F.col("template_id").alias("child_template"), F.col("seq").alias("ordinal"))
    every = admitted(pairs, ["parent_template", "child_template"], key_cap)
    kept = ranked(every.where("admitted").drop("admitted"), "rank", [F.col("count").desc(), F.col("parent_template"), F.col("child_template")]).where(F.col("rank") <= size)
    return kept, every.groupBy(*KEYS).agg(F.sum(F.when(~F.col("admitted"), F.col("count")).otherwise(0)).alias("dropped_span_edge_observations"))
