"""Documents: the fingerprint of each window, as one long frame per block, and their nested JSON form."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CUBE_BUDGET, KEYS, VERSION, Config
from ..functions.stats import finite_or_fail
from ..functions.text import duration_seconds, format_rfc3339, level_token, outcome_token, role_name, row_level_token, ticks, well_formed
from ..operators import behavior, churn, cube, histograms, reservoir as salient, stats, topology
from ..operators.order import with_ordinal
from ..sources.events import under_cap
from ..sources.shared import materialise

#: Blocks beyond the retained templates, each computed only if asked for.
BLOCKS = frozenset({"behavior", "cube", "histograms", "topology", "stability"})
ROW = ["template_id", "count", "frequency", "level", "level_declared", "component", "role", "surprise", "novelty", "salience", "retention_axis", "within_window_ordinal", "churn"]


@dataclass(frozen=True)
class Documents:
    """Frames keyed by source and window_id. header has one row a document; rows are the retained templates (block top or
    reservoir, place). A block that documents don't carry is None."""

    header: DataFrame
    rows: DataFrame
    ngrams: DataFrame | None = None
    branching: DataFrame | None = None
    path: DataFrame | None = None
    slots: DataFrame | None = None
    values: DataFrame | None = None
    ordinals: DataFrame | None = None
    joint: DataFrame | None = None
    states: DataFrame | None = None
    stability: DataFrame | None = None
    acquisition: DataFrame | None = None
    service: DataFrame | None = None
    service_dropped: DataFrame | None = None
    span_edges: DataFrame | None = None
    span_dropped: DataFrame | None = None
    registry: DataFrame | None = None

    def at(self, expression: str) -> Documents:
        """The same documents under another window id, an SQL expression of the old one; null drops a document."""
        move = lambda f: f if f is None else f.withColumn("window_id", F.expr(expression)).where("window_id is not null")
        frames = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "registry"}
        return replace(self, **{k: move(f) for k, f in frames.items()})


LEAF = "array<struct<ref:string,start_ticks:bigint,end_ticks:bigint>>"
SOURCE = "struct<service:string,fleet:string,host_count:bigint,host:string,tags:array<struct<key:string,value:string>>>"
PROVENANCE = f"array<struct<start:timestamp,end:timestamp,json:string,source:string,source_block:{SOURCE},lines:bigint,coordinate:{LEAF}>>"


def source_block(config: Config) -> Column:
    b = config.source_block
    tags = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(b.tags)])
    return F.struct(F.lit(b.service).alias("service"), F.lit(b.fleet).alias("fleet"), F.lit(b.host_count).alias("host_count"), F.lit(b.host).alias("host"), tags.alias("tags")).cast(SOURCE)


def previous_ends(stability: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds the end of the window before each one."""
    return stability.join(ends.select("source", (F.col("window_id") + 1).alias("window_id"), F.col("end").alias("previous_window_end")), KEYS, "left")


def fingerprint(events: DataFrame, config: Config = Config(), reported: DataFrame | None = None, blocks: frozenset[str] | set[str] = BLOCKS, outcomes: DataFrame | None = None) -> Documents:
    """One document per window of ``events``, with the ``blocks`` asked for. ``reported`` (window, start, end) overrides the
    events' own envelope; ``outcomes`` (window, run_outcome) says how a window's run ended. Components and parameters are
    put under the text cap that the documents declare before anything groups by them."""
    # what several blocks read is written once: plans stay small, and nothing is counted twice
    rows = materialise(with_ordinal(under_cap(events, config.max_text_bytes)), "events")
    ranks = materialise(stats.with_rank(stats.template_stats(rows)), "templates")
    table = refused = edges = held = None
    if "behavior" in blocks or config.reservoir_size:
        table, refused = behavior.split(materialise(behavior.ngram_counts(rows, config), "ngrams"), config)
        edges = behavior.graph(table)
    if config.reservoir_size:
        held = materialise(salient.reservoir(salient.candidates(ranks, behavior.surprise(edges), config.top_k_size), config), "reservoir")
    top = stats.top_k(ranks, config.top_k_size)
    blank = lambda t: F.lit(None).cast(t)
    ordinal = F.col("first_seen") if config.source_ref else blank("bigint")
    kept_top = top.select(*KEYS, F.lit("top").alias("block"), F.col("rank").alias("place"), "template_id", "count", "frequency", "level", "level_declared", "component", "role", blank("int").alias("surprise"), blank("int").alias("novelty"), blank("int").alias("salience"), blank("string").alias("retention_axis"), blank("bigint").alias("within_window_ordinal"), churn.retained().alias("churn"))
    kept = kept_top if held is None else kept_top.unionByName(held.select(*KEYS, F.lit("reservoir").alias("block"), F.col("slot").alias("place"), "template_id", "count", "frequency", "level", "level_declared", "component", "role", "surprise", "novelty", "salience", "retention_axis", ordinal.alias("within_window_ordinal"), churn.retained().alias("churn")))
    bounds = rows.groupBy(*KEYS).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), ticks(F.min("ts")).alias("_open"), ticks(F.max("ts")).alias("_close"))
    if reported is not None:
        bounds = bounds.drop("start", "end").join(reported, KEYS, "left")
    declared = {
        "top_k_size": (config.top_k_size, "int"), "reservoir_size": (config.reservoir_size or None, "int"), "ngram_size": (config.effective_ngram_size if config.top_ngrams_size and "behavior" in blocks else None, "int"),
        "top_ngrams_size": (config.top_ngrams_size, "int"), "param_histograms_size": ((config.max_param_histograms or None) if "histograms" in blocks else None, "int"), "value_counts_size": (config.max_histogram_values if config.max_param_histograms and "histograms" in blocks else None, "int"),
        "canonicalization_version": (config.canonicalization_version, "string"), "retention_profile": (config.retention_profile, "string"), "ruleset": (config.ruleset, "string"), "transport": (config.transport, "string"),
        "max_text_bytes": (config.max_text_bytes, "int"), "producer_version": (config.producer_version, "string"), "source_ref": (config.source_ref, "string"), "span_windows": (1, "int"), "branching_size": (config.top_branching_size, "int"), "span_edges_size": (config.span_edges_size, "int"),
    }
    header = bounds.join(stats.window_totals(ranks), KEYS).join(stats.tail(ranks, config.top_k_size, held), KEYS, "left")
    if "behavior" in blocks:
        counts = edges.groupBy(*KEYS).agg(F.count("*").alias("graph_edge_count"))
        header = header.join(refused.drop("admitted_keys"), KEYS, "left").join(counts, KEYS, "left")
    else:
        header = header.withColumns({"dropped_ngram_observations": blank("bigint"), "graph_edge_count": blank("bigint")})
    header = header.withColumns({k: F.lit(v).cast(t) for k, (v, t) in declared.items()})
    # the coordinate leads back to what was read, whatever bounds are reported
    leaf = F.array(F.struct(F.col("source_ref").alias("ref"), F.col("_open").alias("start_ticks"), F.col("_close").alias("end_ticks")))
    header = header.withColumns({"coordinate": F.when(F.col("source_ref").isNotNull(), leaf).cast(LEAF), "provenance": F.array().cast(PROVENANCE), "source_block": source_block(config)}).drop("_open", "_close")
    if outcomes is None:
        header = header.withColumn("run_outcome", blank("string"))
    else:
        header = header.join(outcomes.select(*KEYS, outcome_token(F.col("run_outcome")).alias("run_outcome")), KEYS, "left")
    header = materialise(header, "header")
    slots = values = bins = None
    if config.max_param_histograms and "histograms" in blocks:
        # events of other templates are left out before their values are counted and hashed
        kept_rows = rows.join(top.select(*KEYS, "template_id"), [*KEYS, "template_id"], "left_semi")
        values = materialise(histograms.field_values(kept_rows, config.max_param_histograms, config.max_histogram_values), "values")
        slots = histograms.field_histograms(kept_rows, config.max_param_histograms, config.max_histogram_values, counted=values)
        bins = histograms.ordinal_bins(kept_rows).drop("component").groupBy(*KEYS, "template_id", "field_name", "schedule", "bin").agg(F.sum("n").alias("n")).join(top.select(*KEYS, "template_id", "component"), [*KEYS, "template_id"])
        bins = materialise(bins, "bins")
    docs = Documents(header=header, rows=kept, slots=slots, values=values, ordinals=bins, registry=rows.select("template_id", "template_str").distinct())
    if "behavior" in blocks:
        path = behavior.dominant_path(edges, ranks, config.dominant_path_max_steps) if config.dominant_path_max_steps else None
        docs = replace(docs, ngrams=behavior.top_ngrams(table, config.top_ngrams_size), branching=behavior.branching(edges, config.top_branching_size), path=path)
    if "stability" in blocks and config.emit_stability:
        docs = replace(docs, stability=previous_ends(stats.stability(ranks), header.select(*KEYS, "end")))
    if "cube" in blocks:
        joint = materialise(cube.base(rows), "joint")
        states = materialise(cube.collapse_states(joint), "states")
        joint = materialise(cube.coarsen(joint.join(states, KEYS), F.col("band_floor"), F.col("floor_depth")), "joint")
        docs = replace(docs, joint=joint, states=states, acquisition=cube.acquisition(rows, cube.closed(joint)))
    if "topology" in blocks:
        # links and parents are read by several plans
        spans = materialise(rows.where("is_span").select(*KEYS, "seq", "template_id", "component", "span_id", "parent_span_id", "linked_span_ids"), "spans")
        live = topology.active_spans(spans, config.max_active_spans)
        resolved = topology.resolve(spans.where("parent_span_id is not null").select(*KEYS, "seq", "parent_span_id", "template_id", "component"), live)
        links = topology.resolve(topology.link_edges(spans), live)
        service, dropped = topology.service_edges(resolved, links, config.max_service_edges)
        span_edges, refused_edges = topology.span_edges(resolved, config.span_edges_size, config.max_span_edge_keys)
        # the blocks are there, if empty, wherever a window has spans
        spoken = spans.select(*KEYS).distinct()
        docs = replace(docs, service=service, service_dropped=spoken.join(dropped, KEYS, "left"), span_edges=span_edges, span_dropped=spoken.join(refused_edges, KEYS, "left"))
        if docs.acquisition is not None:
            parents, linked = (topology.orphans(r).select(*KEYS, F.col("orphan_parent_edges").alias(n)) for r, n in ((resolved, "orphan_parent_edges"), (links, "orphan_link_edges")))
            docs = replace(docs, acquisition=docs.acquisition.join(parents, KEYS, "left").join(linked, KEYS, "left"))
    return docs


def _list(frame: DataFrame | None, order: list[Column], entry: Column, name: str, keys: list[str] = KEYS) -> DataFrame | None:
    """Rows of a block as one sorted array per document."""
    if frame is None:
        return None
    item = F.struct(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("o"), entry.alias("e"))
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return frame.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item), by_order), lambda x: x["e"]).alias(name))


def churn_entry(c: Column) -> Column:
    """Churn on the wire: only over two windows or more; unknown presence is omitted."""
    seen = lambda x: F.when(x == churn.PRESENT, True).when(x == churn.ABSENT, False)
    return F.when(c["span"] >= 2, F.struct(c["span"].alias("span_windows"), c["transitions"].alias("transitions"), c["indeterminate"].alias("indeterminate"), seen(c["first"]).alias("first"), seen(c["last"]).alias("last")))


def coordinate(level: Column, component: Column, role: Column, latency_shift: Column | None = None) -> Column:
    """A cell's place; aggregated axes are omitted."""
    shift = [] if latency_shift is None else [latency_shift.alias("latency_shift")]
    return F.struct(level_token(level).alias("level"), F.when(component.isNotNull(), F.array(well_formed(component))).alias("where"), role_name(role).alias("structural_role"), *shift)


def axes(band_floor: Column, floor_depth: Column, shift: bool = False) -> Column:
    """The cube's axes with what was coarsened on them."""
    kind = "struct<name:string,kind:string,chain:array<string>,floor_depth:int,band_floor:int>"
    axis = lambda name, kind_, chain=None, depth=None, band=None: F.struct(F.lit(name), F.lit(kind_), F.array(F.lit(chain)) if chain else F.lit(None), depth if depth is not None else F.lit(None), band if band is not None else F.lit(None)).cast(kind)
    found = [axis("level", "categorical", band=F.nullif(band_floor, F.lit(0))), axis("where", "chain", "component", depth=floor_depth), axis("structural_role", "categorical")]
    return F.array(*found, *([axis("latency_shift", "categorical")] if shift else []))


def source_wire(block: Column) -> Column:
    tags = F.when(F.size(block["tags"]) > 0, F.map_from_entries(block["tags"]))
    return F.struct(block["service"].alias("service"), block["fleet"].alias("fleet"), block["host_count"].alias("host_count"), block["host"].alias("host"), tags.alias("tags"))


def coordinate_wire(leaves: Column, version: Column) -> Column:
    """One leaf has its reference and bounds, several are children of a coordinate that has neither."""
    one = lambda x: F.struct(F.struct(F.lit("table").alias("resolver_kind"), x["ref"].alias("handle")).alias("source_ref"), F.struct(x["start_ticks"].alias("start_tick"), x["end_ticks"].alias("end_tick")).alias("bounds"), version.alias("canonicalization_version"))
    child = F.transform(leaves, one)
    single, several = F.size(leaves) == 1, F.size(leaves) > 1
    pick = lambda name: F.when(single, F.get(child, F.lit(0))[name]).alias(name)
    return F.when(single | several, F.struct(pick("source_ref"), pick("bounds"), pick("canonicalization_version"), F.when(several, child).alias("children")))


def window_wire(start: Column, end: Column) -> list[Column]:
    """Start and end are there together or not at all."""
    both = start.isNotNull() & end.isNotNull()
    return [F.when(both, format_rfc3339(start)).alias("start"), F.when(both, format_rfc3339(end)).alias("end")]


def _histograms(docs: Documents) -> DataFrame | None:
    """Parameter and ordinal histograms of each template, as they stand in its entry."""
    keys, out = [*KEYS, "template_id"], None
    if docs.slots is not None:
        counts = docs.values.where("admitted").groupBy(*histograms.SLOT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(well_formed(F.col("value")).alias("value"), "count")))).alias("value_counts"))
        entry = F.struct("param_index", "value_counts", "total", F.when(F.col("cardinality") > 0, F.col("cardinality")).alias("approximate_cardinality"))
        out = _list(docs.slots.join(counts, histograms.SLOT, "left"), [F.col("param_index")], entry, "param_histograms", keys)
    if docs.ordinals is not None:
        entry = F.struct("field_name", F.col("schedule").alias("schedule_id"), "counts", "total")
        own = _list(histograms.ordinal_histograms(docs.ordinals), [F.col("field_name")], entry, "ordinal_histograms", keys)
        out = own if out is None else out.join(own, keys, "full")
    return out


def nested(docs: Documents, vendor: str = "") -> DataFrame:
    """One row per document with the column ``document``, a nested struct; absent blocks are null. ``vendor`` begins the
    names of members that are extensions."""
    rows = docs.rows
    if docs.registry is not None:
        rows = rows.join(docs.registry, "template_id", "left")
    else:
        rows = rows.withColumn("template_str", F.lit(None).cast("string"))
    found = _histograms(docs)
    if found is not None:
        rows = rows.join(found, [*KEYS, "template_id"], "left")
    at = F.col("place") - 1
    level, component, template = row_level_token(F.col("level")), well_formed(F.col("component")), F.nullif(well_formed(F.col("template_str")), F.lit(""))
    label = lambda block: ["template_id", "count", finite_or_fail(F.col("frequency"), f"stats.{block}[].frequency", at).alias("frequency"), template.alias("template"), level.alias("level"), component.alias("component")]
    own = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    churned = churn_entry(F.col("churn"))
    extra = F.when(own("ordinal_histograms").isNotNull() | churned.isNotNull(), F.struct(own("ordinal_histograms").alias(f"{vendor}ordinal_histograms"), churned.alias(f"{vendor}presence_churn")))
    top = F.struct(*label("top_k"), own("param_histograms").alias("param_histograms"), extra.alias("extensions"))
    role = F.when(F.col("role") > 0, role_name(F.col("role")))
    held = F.struct(*label("reservoir"), role.alias("structural_role"), F.col("surprise").alias("structural_surprise"), "novelty", "salience", "within_window_ordinal")
    out = docs.header
    lists = [_list(rows.where(F.col("block") == "top"), [F.col("place")], top, "top_k"), _list(rows.where(F.col("block") == "reservoir"), [F.col("place")], held, "reservoir")]
    moved = docs.rows.groupBy(*KEYS).agg(F.count_if(F.col("churn.transitions") > 0).alias("_churned"), F.sum("churn.transitions").alias("_transitions"), F.sum("churn.indeterminate").alias("_indeterminate"))
    lists.append(moved)
    place = F.col("rank") - 1
    if docs.ngrams is not None:
        lists.append(_list(docs.ngrams, [F.col("rank")], F.struct(F.col("ids").alias("sequence"), "count", finite_or_fail(F.col("probability"), "behavior.top_ngrams[].probability", place).alias("probability")), "top_ngrams"))
    if docs.branching is not None:
        lists.append(_list(docs.branching, [F.col("rank")], F.struct("template_id", "fanout", F.col("total").alias("total_outgoing"), finite_or_fail(F.col("entropy_bits"), "behavior.branching[].entropy_bits", place).alias("entropy_bits")), "branching"))
    if docs.path is not None:
        lists.append(_list(docs.path, [F.col("step")], F.col("template_id"), "dominant_path"))
    if docs.joint is not None:
        mask_first = [F.col("pinned"), F.coalesce("level", F.lit(99)), F.col("component").isNull(), F.coalesce("component", F.lit("")), F.coalesce("role", F.lit(99))]
        every = cube.cells(docs.joint)
        lists.append(_list(every.where("closed"), mask_first, F.struct(coordinate(F.col("level"), F.col("component"), F.col("role")).alias("coord"), "count"), "cells"))
        lists += [every.groupBy(*KEYS).agg(F.count("*").alias("raw_cell_count")), docs.states]
    if docs.service is not None:
        edge = lambda c: well_formed(F.col(c)).alias(c)
        lists.append(_list(docs.service, [F.col("caller"), F.col("callee")], F.struct(edge("caller"), edge("callee"), F.col("count").alias("weight")), "service_edges"))
        lists.append(docs.service_dropped.select(*KEYS, F.lit(True).alias("_spans"), "dropped_edges"))
        lists.append(_list(docs.span_edges, [F.col("rank")], F.struct(F.col("parent_template").alias("parent"), F.col("child_template").alias("child"), "count"), "span_edges"))
        lists.append(docs.span_dropped.select(*KEYS, "dropped_span_edge_observations"))
    if docs.acquisition is not None:
        number = lambda c, name: F.coalesce(F.col(c) if c in docs.acquisition.columns else F.lit(None), F.lit(0)).alias(name)
        facts = F.struct(number("located_records", "records_with_component"), number("components", "distinct_components"), number("levels", "level_cardinality"), number("roles", "role_cardinality"), F.array(F.col("components")).alias("where_cardinality_per_depth"), number("closed_cells", "closed_cells"), number("spans", "span_records"), number("orphan_parent_edges", "orphan_parent_edges"), number("orphan_link_edges", "orphan_link_edges"))
        lists.append(docs.acquisition.select(*KEYS, facts.alias("acquisition")))
    if docs.stability is not None:
        s = docs.stability
        ended = format_rfc3339(F.col("previous_window_end")) if "previous_window_end" in s.columns else F.lit(None).cast("string")
        safe = lambda c: finite_or_fail(F.col(c), f"stability.{c}").alias(c)
        lists.append(s.select(*KEYS, F.struct(ended.alias("previous_window_end"), safe("kl_divergence"), safe("js_divergence"), "new_templates", "vanished_templates", safe("stability_score")).alias("stability")))
    for block in lists:
        out = out.join(block, KEYS, "left")
    has = lambda c: F.col(c) if c in out.columns else F.lit(None)
    some = lambda c: F.when(F.size(has(c)) > 0, has(c)) if c in out.columns else F.lit(None)
    tail = F.when(F.col("tail_unique") > 0, F.struct(F.col("tail_unique").alias("tail_template_count"), finite_or_fail(F.col("tail_entropy_bits"), "stats.tail_summary.tail_entropy_bits").alias("tail_entropy_bits"), finite_or_fail(F.col("tail_max_rate"), "stats.tail_summary.tail_max_rate").alias("tail_max_rate")))
    stats_block = F.struct("unique_templates", "top_k_size", "reservoir_size", "param_histograms_size", "value_counts_size", "tail_count", "tail_unique", F.coalesce(has("top_k"), F.array()).alias("top_k"), finite_or_fail(F.col("entropy_bits"), "stats.entropy_bits").alias("entropy_bits"), tail.alias("tail_summary"), some("reservoir").alias("reservoir"))
    branches = some("branching")
    behavior_block = F.when(F.col("ngram_size").isNotNull(), F.struct("ngram_size", F.coalesce(has("top_ngrams"), F.array()).alias("top_ngrams"), "top_ngrams_size", F.nullif(has("dropped_ngram_observations"), F.lit(0)).alias("dropped_ngram_observations"), F.when(branches.isNotNull(), has("branching_size")).alias("branching_size"), has("graph_edge_count").alias("graph_edge_count"), some("dominant_path").alias("dominant_path"), branches.alias("branching")))
    start, end = window_wire(F.col("start"), F.col("end"))
    window = F.struct(start, end, F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), duration_seconds(F.col("start"), F.col("end"))).alias("duration_seconds"), F.col("lines").alias("lines_observed"))
    cube_block = F.when(has("cells").isNotNull(), F.struct(axes(has("band_floor"), has("floor_depth")).alias("axes"), has("cells").alias("cells"), F.size(has("cells")).alias("cell_count"), has("raw_cell_count").alias("raw_cell_count"), F.lit(CUBE_BUDGET).alias("cell_budget"))) if docs.joint is not None else F.lit(None)
    empty = lambda c: F.coalesce(has(c), F.array())
    spoken = F.coalesce(has("_spans"), F.lit(False))
    service = F.when(spoken, F.struct(empty("service_edges").alias("edges"), F.coalesce(has("dropped_edges"), F.lit(0)).alias("dropped_edges"))) if docs.service is not None else F.lit(None)
    span_edges = F.when(spoken, F.struct(empty("span_edges").alias("edges"), has("span_edges_size").alias("span_edges_size"), F.nullif(has("dropped_span_edge_observations"), F.lit(0)).alias("dropped_span_edge_observations"))) if docs.service is not None else F.lit(None)
    summary = F.when(F.col("span_windows") >= 2, F.struct("span_windows", F.col("_churned").alias("templates_with_churn"), F.col("_transitions").alias("total_transitions"), F.col("_indeterminate").alias("total_indeterminate"), F.lit("top_k_union_reservoir").alias("horizon")))
    extensions = F.struct(*[c.alias(f"{vendor}{n}") for n, c in (("acquisition", has("acquisition")), ("service_edges", service), ("span_edges", span_edges), ("transport", F.col("transport")), ("ruleset", F.col("ruleset")), ("presence_churn_summary", summary))])
    any_extension = reduce(lambda a, b: a | b, [c.isNotNull() for c in (has("acquisition"), service, span_edges, F.col("transport"), F.col("ruleset"), summary)])
    past = lambda x: F.struct(F.struct(*window_wire(x["start"], x["end"])).alias("window"), F.when(~_blank_source(x["source_block"]), source_wire(x["source_block"])).alias("source"), x["lines"].alias("lines_observed"), coordinate_wire(x["coordinate"], F.lit(None).cast("string")).alias("coordinate"))
    document = F.struct(
        F.lit(VERSION).alias("version"), F.struct(F.lit("fenestra").alias("name"), F.col("producer_version").alias("version"), F.lit("").alias("implementation_uri")).alias("producer"), window.alias("window"), source_wire(F.col("source_block")).alias("source"),
        stats_block.alias("stats"), behavior_block.alias("behavior"), has("stability").alias("stability"), F.when(F.size("provenance") > 0, F.transform("provenance", past)).alias("provenance"), "canonicalization_version", "retention_profile", "max_text_bytes",
        coordinate_wire(F.col("coordinate"), F.col("canonicalization_version")).alias("coordinate"), cube_block.alias("cube"), "run_outcome", F.when(any_extension, extensions).alias("extensions"))
    return out.select(*KEYS, document.alias("document"))


def _blank_source(block: Column) -> Column:
    return block["service"].isNull() & block["fleet"].isNull() & block["host_count"].isNull() & block["host"].isNull() & (F.size(block["tags"]) == 0)


def to_json(docs: Documents, vendor: str = "") -> DataFrame:
    """(source, window_id, json): absent members are omitted; a value that is not finite fails with its path; ill-formed text
    is repaired."""
    return nested(docs, vendor).select(*KEYS, F.to_json("document", {"ignoreNullFields": "true"}).alias("json"))


def write_json(docs: Documents, path: str, vendor: str = "") -> None:
    to_json(docs, vendor).select("json").write.text(path)
