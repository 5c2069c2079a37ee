"""The registered queries: each applies operators to the driver's tables; oracle.py has the same results as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import KEYS, Config
from ..functions import hll, text
from ..functions.stats import novelty_band
from ..operators import behavior, churn, cube, histograms, reservoir, stats, topology
from ..sources import events as src
from . import compose, diff
from .documents import BLOCKS, fingerprint

RETENTION = Config(top_k_size=16, reservoir_size=16, reservoir_error_reserve=4, reservoir_per_kind_cap=4)


def r6(c: str | Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _ranks(spark: SparkSession, d: str, places: bool = False, **kw) -> DataFrame:
    return stats.with_rank(stats.template_stats(src.driver_events(spark, d, **kw), places))


def _edges(spark: SparkSession, d: str, window: str = "w10", template: str = "coarse", config: Config | None = None) -> DataFrame:
    config = config or Config(trace_scoping_enabled=False)
    return behavior.graph(behavior.ngrams(src.driver_events(spark, d, window=window, template=template), config)[0])


def template_ids(spark, d):
    e = src.driver_events(spark, d, template="fine")
    return src.registry(e).select("template_id", "template_str")


def window_top_k(spark, d):
    return stats.top_k(_ranks(spark, d), 16).select("window_id", F.col("rank").cast("long"), "template_id", "template_str", "count", r6("frequency").alias("frequency"))


def window_entropy(spark, d):
    t = stats.window_totals(stats.template_stats(src.driver_events(spark, d), False))
    return t.select("window_id", "lines", "unique_templates", r6("entropy_bits").alias("entropy_bits"))


def tail_summary(spark, d):
    t = stats.tail(_ranks(spark, d), 16)
    return t.select("window_id", "tail_count", "tail_unique", r6("tail_entropy_bits").alias("tail_entropy_bits"), r6("tail_max_rate").alias("tail_max_rate"))


def dominant_level(spark, d):
    s = stats.template_stats(src.driver_events(spark, d, template="kmod"), False)
    return s.select("window_id", "template_str", F.col("level").cast("long").alias("level"), "level_declared")


def dominant_component(spark, d):
    s = stats.template_stats(src.driver_events(spark, d, template="kmod", component="svc"), False)
    return s.select("window_id", "template_str", "component")


def dominant_role(spark, d):
    s = stats.template_stats(src.driver_events(spark, d, template="kmod"), False)
    return s.select("window_id", "template_str", F.col("role").cast("long").alias("role"))


def first_seen_rank(spark, d):
    return _ranks(spark, d, True).select("window_id", "template_id", "first_seen", F.col("internal_id").cast("long").alias("internal_id"))


def new_vanished(spark, d):
    return stats.stability(stats.template_stats(src.driver_events(spark, d, template="fine"), False)).select("window_id", "new_templates", "vanished_templates")


def stability_kl_js(spark, d):
    s = stats.stability(stats.template_stats(src.driver_events(spark, d), False))
    return s.select("window_id", r6("kl_divergence").alias("kl_divergence"), r6("js_divergence").alias("js_divergence"), r6("stability_score").alias("stability_score"))


def window_spine(spark, d):
    return stats.spine(stats.template_stats(src.driver_events(spark, d), False)).select("window_id")


def _ngrams(spark, d, config: Config, **kw):
    table, _ = behavior.ngrams(src.driver_events(spark, d, **kw), config)
    top = behavior.top_ngrams(table, config.top_ngrams_size)
    return top.select("window_id", F.col("rank").cast("long"), F.array_join("ids", ">").alias("sequence"), "count", r6("probability").alias("probability"))


def ngram_bigrams(spark, d):
    return _ngrams(spark, d, Config(trace_scoping_enabled=False))


def ngram_trigrams(spark, d):
    return _ngrams(spark, d, Config(ngram_size=3, trace_scoping_enabled=False), window="w10")


def ngram_trace_scoped(spark, d):
    return _ngrams(spark, d, Config(max_active_traces=1 << 30), window="w10", template="type")


def ngram_key_cap_dropped(spark, d):
    _, refused = behavior.ngrams(src.driver_events(spark, d, window="w10", template="fine"), Config(trace_scoping_enabled=False, max_ngram_keys=200))
    return refused.select("window_id", "admitted_keys", "dropped_ngram_observations")


def graph_edges(spark, d):
    return _edges(spark, d).select("window_id", "from_id", "to_id", "count", "outgoing")


def branching_entropy(spark, d):
    b = behavior.branching(_edges(spark, d), 64)
    return b.select("window_id", "template_id", "fanout", "total", r6("entropy_bits").alias("entropy_bits"))


def branching_trigram(spark, d):
    b = behavior.branching(_edges(spark, d, config=Config(ngram_size=3, trace_scoping_enabled=False)), 64)
    return b.select("window_id", "template_id", "fanout", "total", r6("entropy_bits").alias("entropy_bits"))


def dominant_path(spark, d):
    e = src.driver_events(spark, d, window="w10")
    p = behavior.dominant_path(_edges(spark, d), stats.with_rank(stats.template_stats(e, False)), 8)
    return p.select("window_id", F.col("step").cast("long").alias("step"), "template_id")


def surprise_band(spark, d):
    return behavior.surprise(_edges(spark, d)).select("window_id", "template_id", "edge_count", "source_outgoing", F.col("surprise").cast("long").alias("surprise"))


def novelty(spark, d):
    r = _ranks(spark, d, True, window="w10", template="fine")
    return r.select("window_id", "template_id", novelty_band(F.col("first_seen"), F.col("lines"), F.col("count")).cast("long").alias("novelty"))


def _reservoir(spark, d) -> tuple[DataFrame, DataFrame]:
    ranks = _ranks(spark, d, True, window="w10")
    found = reservoir.candidates(ranks, behavior.surprise(_edges(spark, d)), RETENTION.top_k_size)
    return ranks, reservoir.reservoir(found, RETENTION)


def salience_reservoir(spark, d):
    held = _reservoir(spark, d)[1]
    return held.select("window_id", F.col("slot").cast("long").alias("slot"), "template_id", "count", F.col("salience").cast("long").alias("salience"), "retention_axis")


def tail_after_reservoir(spark, d):
    ranks, held = _reservoir(spark, d)
    t = stats.tail(ranks, RETENTION.top_k_size, held)
    return t.select("window_id", "tail_count", "tail_unique", r6("tail_entropy_bits").alias("tail_entropy_bits"))


def _joint(spark, d, **kw) -> DataFrame:
    return cube.base(src.driver_events(spark, d, **kw))


def _cells(c: DataFrame) -> DataFrame:
    return c.select("window_id", F.col("level").cast("long").alias("level"), "component", F.col("role").cast("long").alias("role"), "count")


def cube_base(spark, d):
    return _cells(_joint(spark, d))


def cube_raw(spark, d):
    return _cells(cube.cells(_joint(spark, d)))


def cube_closed(spark, d):
    return _cells(cube.closed(_joint(spark, d)))


def cube_collapsed(spark, d):
    """The same cubes under a budget of 100 cells, which makes every window collapse."""
    b = cube.bounded(_joint(spark, d), 100)
    return b.groupBy("window_id", "band_floor", "floor_depth").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("pinned") == 0, F.col("count"))).alias("total")).select("window_id", F.col("band_floor").cast("long").alias("band_floor"), F.col("floor_depth").cast("long").alias("floor_depth"), "cells")


def cube_cardinality(spark, d):
    c = cube.cardinality(cube.closed(_joint(spark, d)))
    return c.select("window_id", "level_cardinality", "component_cardinality", "role_cardinality", "closed_cells")


def _border(spark, d, side: str) -> DataFrame:
    joint = _joint(spark, d)
    later = joint.withColumn("window_id", F.col("window_id") + 1)
    both = joint.select(*KEYS).distinct().join(later.select(*KEYS).distinct(), KEYS)
    b = cube.border(later.join(both, KEYS, "left_semi"), joint.join(both, KEYS, "left_semi"), KEYS)
    return _cells(b.where(F.col("side") == side))


def cube_emerging_upper(spark, d):
    return _border(spark, d, "upper")


def cube_emerging_lower(spark, d):
    return _border(spark, d, "lower")


def acquisition(spark, d):
    e = src.driver_events(spark, d)
    return cube.acquisition(e, cube.closed(cube.base(e))).select("window_id", "located_records", "components", "levels", "roles", "closed_cells")


def field_histogram_capped(spark, d):
    h = histograms.field_histograms(src.driver_events(spark, d, window="w10", template="type"), 2, 8, approximate=False)
    return h.select("window_id", "template_id", F.col("param_index").cast("long").alias("param_index"), "total", "kept_values", "kept_count", r6("entropy_bits").alias("entropy_bits"))


def histogram_js(spark, d):
    v = histograms.field_values(src.driver_events(spark, d, window="w15", template="type"), 2, 64).where("admitted and param_index = 1")
    v = v.withColumn("total", F.sum("count").over(W.partitionBy(*histograms.SLOT)))
    keys = ["source", "template_id", "param_index"]
    js = histograms.histogram_divergence(v.where("window_id = 0"), v.where("window_id = 1"), keys)
    return js.select("template_id", r6("js_divergence").alias("js_divergence"))


def hll_cardinality(spark, d):
    v = histograms.param_values(src.driver_events(spark, d, window="w10", template="type"), 1)
    return hll.cardinality(v, ["window_id", "template_id"], "value").select("window_id", "template_id", "estimate")


def ordinal_histogram(spark, d):
    b = histograms.ordinal_bins(src.driver_events(spark, d, window="w10", template="type"))
    return b.groupBy("window_id", "template_id", "field_name", "bin").agg(F.sum("n").alias("n")).select("window_id", "template_id", "field_name", F.col("bin").cast("long").alias("bin"), "n")


def w1_latency_shift(spark, d):
    b = histograms.ordinal_bins(src.driver_events(spark, d, window="w15", template="type", component="svc", slow_half=True))
    per = b.groupBy("window_id", "component", "bin").agg(F.sum("n").alias("n"))
    s = histograms.w1_shift(per.where("window_id = 0"), per.where("window_id = 1"), ["component"])
    return s.select("component", "previous_total", "current_total", r6("octaves").alias("octaves"), "shift", "direction", text.shift_label(F.col("shift"), F.col("direction")).alias("label"))


def _resolved(spark, d) -> tuple[DataFrame, DataFrame]:
    spans, kids = src.driver_spans(spark, d)
    return topology.resolve(kids, topology.active_spans(spans, 0)), spans


def service_edges(spark, d):
    return topology.service_edges(_resolved(spark, d)[0], None, 100)[0].select("window_id", "caller", "callee", "count")


def service_edges_dropped(spark, d):
    return topology.service_edges(_resolved(spark, d)[0], None, 100)[1].select("window_id", "dropped_edges")


def span_edges(spark, d):
    e = topology.span_edges(_resolved(spark, d)[0], 32, 4096)[0]
    return e.select("window_id", F.col("rank").cast("long"), "parent_template", "child_template", "count")


def orphan_edges(spark, d):
    return topology.orphans(_resolved(spark, d)[0]).select("window_id", "orphan_parent_edges", "resolved_edges")


def active_spans_capped(spark, d):
    live = topology.active_spans(src.driver_spans(spark, d)[0], 50)
    return live.select("window_id", "span_id")


def template_deltas(spark, d):
    docs = _documents(spark, d, Config(top_k_size=16), set())
    return diff.template_deltas(*docs).select("template_id", "state", "previous_count", "current_count", "delta", F.col("rank").cast("long"))


def _documents(spark, d, config: Config = RETENTION, blocks: frozenset[str] | set[str] = BLOCKS, **kw):
    """The fingerprints of the first and of the second half of the month, keyed as one pair."""
    docs = fingerprint(src.driver_events(spark, d, window="w15", component="svc", slow_half=True, **kw), config, blocks=blocks)
    return docs.at("CASE WHEN window_id = 0 THEN 0 END"), docs.at("CASE WHEN window_id = 1 THEN 0 END")


def diff_divergence(spark, d):
    x = diff.divergence(*_documents(spark, d, Config(top_k_size=16), set()))
    return x.select(r6("kl_divergence").alias("kl_divergence"), r6("js_divergence").alias("js_divergence"), r6("stability_score").alias("stability_score"))


def diff_outcome(spark, d):
    o = diff.outcome(diff.diff(*_documents(spark, d, Config(top_k_size=16, reservoir_size=16, max_param_histograms=2))))
    return o.select("comparison_outcome", F.array_join("withheld_signals", ",").alias("withheld_signals"))


def diff_ngrams(spark, d):
    x = diff.ngram_delta(*_documents(spark, d, Config(trace_scoping_enabled=False), {"behavior"}))
    return x.select("state", F.array_join("ids", ">").alias("sequence"), r6("previous_probability").alias("previous_probability"), r6("current_probability").alias("current_probability"))


def cube_latency_border(spark, d):
    c = diff.cube_diff(*_documents(spark, d, Config(max_param_histograms=2), {"cube", "histograms"}))
    return c.select("direction", "side", F.col("level").cast("long").alias("level"), "component", F.col("role").cast("long").alias("role"), "latency_shift", "count")


def reservoir_delta(spark, d):
    x = diff.reservoir_delta(*_documents(spark, d, RETENTION, set()))
    return x.select("kind", "template_id", "previous_count", "current_count")


def compose_pair_top_k(spark, d):
    c = compose.compose(*_documents(spark, d, Config(top_k_size=16), set()))
    return c.rows.where("block = 'top'").select(F.col("place").cast("long").alias("rank"), "template_id", "count", r6("frequency").alias("frequency"))


def compose_tail(spark, d):
    c = compose.compose(*_documents(spark, d, Config(top_k_size=16), set()))
    return c.header.select("lines", "tail_count", "tail_unique", r6("entropy_bits").alias("entropy_bits"), r6("tail_entropy_bits").alias("tail_entropy_bits"))


def compose_ngrams(spark, d):
    c = compose.compose(*_documents(spark, d, Config(trace_scoping_enabled=False), {"behavior"}))
    return c.ngrams.select(F.col("rank").cast("long"), F.array_join("ids", ">").alias("sequence"), "count", r6("probability").alias("probability"))


def compose_cube(spark, d):
    c = compose.compose(*_documents(spark, d, RETENTION, {"cube"}))
    return cube.closed(c.joint).select(F.col("level").cast("long").alias("level"), "component", F.col("role").cast("long").alias("role"), "count")


def compose_fold_month(spark, d):
    """Three ten-day documents folded in order, with their churn."""
    docs = fingerprint(src.driver_events(spark, d, window="w10"), RETENTION, blocks=set())
    c = compose.fold(docs, [0, 1, 2])
    return c.rows.select("block", F.col("place").cast("long").alias("place"), "template_id", "count", "churn.*")


def presence_churn(spark, d):
    """Each fine template's presence, day by day on the spine, from exhaustive windows."""
    s = stats.template_stats(src.driver_events(spark, d, template="fine"), False)
    grid = stats.spine(s).join(s.select("source", "template_id").distinct(), "source")
    seen = grid.join(s.select(*KEYS, "template_id", F.lit(churn.PRESENT).alias("p")), [*KEYS, "template_id"], "left").withColumn("p", F.coalesce("p", F.lit(churn.ABSENT)))
    f = churn.fold(seen, ["template_id"], "window_id", "p")
    return f.select("template_id", F.col("churn.span").cast("long").alias("span"), F.col("churn.transitions").cast("long").alias("transitions"), (F.col("churn.first") == churn.PRESENT).alias("present_first"), (F.col("churn.last") == churn.PRESENT).alias("present_last"))


def cap_text(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").select("text").distinct()
    return t.select(text.template_id(F.col("text")).alias("text_id"), text.cap_text(F.col("text"), 64).alias("capped"), text.is_digest_form(text.cap_text(F.col("text"), 64), 64).alias("digest"))


def conversation_bigrams(spark, d):
    """Role transitions of conversations: a ring per conversation."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    e = src.canonical(c.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), F.col("role").alias("template_str"), F.col("conv_id").alias("trace_id")))
    table, _ = behavior.ngrams(e, Config(max_active_traces=1 << 30))
    return table.select(F.array_join("ids", ">").alias("sequence"), "count", r6("probability").alias("probability"))


def admission_budget(spark, d):
    """Events whose template the first day knew, or that is among the first 20 new ones."""
    e = src.driver_events(spark, d, template="fine")
    known = src.registry(e.where("window_id = 0"))
    return src.admit(e.where("window_id > 0"), known, budget=20).groupBy("window_id").agg(F.count("*").alias("events"), F.countDistinct("template_id").alias("templates"))


def document_sources(spark, d):
    """Documents as events: the template is the source, the level follows from the labels."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    level = F.when(F.col("toxic") == 1, 4).when(F.col("quality") == 0, 3).otherwise(2)
    rows = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("seq"), F.col("source").alias("template_str"), level.alias("level"), F.col("lang").alias("component"))
    s = stats.with_rank(stats.template_stats(src.canonical(rows), False))
    return s.select("template_str", "count", F.col("level").cast("long").alias("level"), "component", F.col("rank").cast("long"))


def queries() -> dict:
    skip = {"r6", "queries"}
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in skip and getattr(f, "__module__", "") == __name__}
