"""Comparison of two documents, previous and current, block by block. Frames are keyed by the pair's source and window_id.

Blocks that can't be compared are not computed but stated, with a reason, in ``incomparable``.
"""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import KEYS, VERSION
from ..functions.stats import finite_or_fail
from ..functions.text import is_failure, role_name, row_level_token, shift_label
from ..operators import cube, histograms, stats
from ..operators.order import ranked
from .compose import gates
from .documents import Documents, _list, axes, coordinate, window_wire

#: Signals that may be missing for a stated reason.
SIGNALS = ("ngram_delta", "branching_delta", "cube_diff", "reservoir_delta", "field_histogram_deltas")


def diff_header(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs with both line totals; fails where the sides are not comparable or declare slots without a value cap."""
    pairs = gates(previous, current, "diff")
    loose = lambda s: F.col(f"{s}.param_histograms_size").isNotNull() & F.col(f"{s}.value_counts_size").isNull()
    bad = F.when(loose("l") | loose("r"), F.lit("diff: param_histograms_size without value_counts_size"))
    return pairs.withColumn("window_id", F.when(bad.isNull(), F.col("window_id")).otherwise(F.raise_error(bad).cast("long")))


def _top(docs: Documents) -> DataFrame:
    rows = docs.rows.where("block = 'top'").join(docs.header.select(*KEYS, F.col("lines").alias("total")), KEYS)
    return rows


def divergence(previous: Documents, current: Documents) -> DataFrame:
    """Over the truncated top lists, within all lines of each side."""
    d = stats.divergences(_top(previous), _top(current), KEYS, ["template_id"])
    return d.select(*KEYS, "kl_divergence", "js_divergence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("js_divergence"))).alias("stability_score"))


def template_deltas(previous: Documents, current: Documents) -> DataFrame:
    """Every template of either top list: counts, delta, and whether it is new, vanished or common."""
    a = previous.rows.where("block = 'top'").select(*KEYS, "template_id", F.col("count").alias("previous_count"), F.col("frequency").alias("previous_frequency"))
    b = current.rows.where("block = 'top'").select(*KEYS, "template_id", F.col("count").alias("current_count"), F.col("frequency").alias("current_frequency"))
    pairs = previous.header.select(*KEYS).join(current.header.select(*KEYS), KEYS)
    both = a.join(b, [*KEYS, "template_id"], "full").join(pairs, KEYS, "left_semi")
    delta = F.coalesce("current_count", F.lit(0)) - F.coalesce("previous_count", F.lit(0))
    state = F.when(F.col("previous_count").isNull(), "new").when(F.col("current_count").isNull(), "vanished").otherwise("common")
    return ranked(both.withColumns({"delta": delta, "state": state}), "rank", [F.abs("delta").desc(), F.col("template_id")])


def branching_delta(previous: Documents, current: Documents) -> DataFrame:
    """Sources with a row on both sides; a pair in which nothing moved has no rows."""
    a = previous.branching.select(*KEYS, "template_id", F.col("entropy_bits").alias("previous_entropy_bits"))
    both = a.join(current.branching.select(*KEYS, "template_id", F.col("entropy_bits").alias("current_entropy_bits")), [*KEYS, "template_id"])
    both = both.withColumn("delta_bits", F.col("current_entropy_bits") - F.col("previous_entropy_bits"))
    moved = both.where("delta_bits != 0").select(*KEYS).distinct()
    return ranked(both.join(moved, KEYS, "left_semi"), "rank", [F.abs("delta_bits").desc(), F.col("template_id")])


def _same_order(previous: Documents, current: Documents) -> DataFrame:
    a = previous.header.select(*KEYS, F.col("ngram_size").alias("_a"))
    return a.join(current.header.select(*KEYS, F.col("ngram_size").alias("_b")), KEYS).where("_a = _b").select(*KEYS)


def ngram_delta(previous: Documents, current: Documents) -> DataFrame:
    """Sequences that are new, vanished or of another rate."""
    a = previous.ngrams.select(*KEYS, "ids", F.col("probability").alias("previous_probability"))
    b = current.ngrams.select(*KEYS, "ids", F.col("probability").alias("current_probability"))
    both = a.join(b, [*KEYS, "ids"], "full").join(_same_order(previous, current), KEYS, "left_semi")
    state = F.when(F.col("previous_probability").isNull(), "new").when(F.col("current_probability").isNull(), "vanished").otherwise("rate_changed")
    both = both.withColumns({"state": state, "delta": F.col("current_probability") - F.col("previous_probability")}).where("state != 'rate_changed' or delta != 0")
    return ranked(both, "rank", [F.abs("delta").desc_nulls_last(), F.col("ids")], [*KEYS, "state"])


def edge_delta(previous: DataFrame, current: DataFrame, ends: list[str], counts: bool) -> DataFrame:
    """Edges that are new or vanished and, with ``counts``, those whose count moved."""
    both = previous.select(*KEYS, *ends, F.col("count").alias("previous_count")).join(current.select(*KEYS, *ends, F.col("count").alias("current_count")), [*KEYS, *ends], "full")
    state = F.when(F.col("previous_count").isNull(), "new").when(F.col("current_count").isNull(), "vanished").otherwise("changed")
    rows = both.withColumn("state", state)
    return rows.where("state != 'changed' or previous_count != current_count") if counts else rows.where("state != 'changed'")


def field_histogram_deltas(previous: Documents, current: Documents) -> DataFrame:
    """Slots of both sides: divergence of their kept values, entropies, samples, cardinalities."""
    side = lambda d: d.values.where("admitted").join(d.slots.select(*histograms.SLOT, "total"), histograms.SLOT)
    js = histograms.histogram_divergence(side(previous), side(current), histograms.SLOT)
    name = lambda d, p: d.slots.select(*histograms.SLOT, *[F.col(c).alias(f"{p}_{c}") for c in ("total", "entropy_bits", "cardinality")])
    rows = js.join(name(previous, "previous"), histograms.SLOT).join(name(current, "current"), histograms.SLOT)
    rows = rows.withColumn("cardinality_delta", F.col("current_cardinality") - F.col("previous_cardinality"))
    moved = (F.col("js_divergence") != 0) | (F.col("previous_entropy_bits") != F.col("current_entropy_bits")) | (F.coalesce("cardinality_delta", F.lit(0)) != 0)
    return ranked(rows.withColumn("moved", moved), "rank", [F.col("js_divergence").desc(), F.col("template_id"), F.col("param_index")])


def ordinal_histogram_deltas(previous: Documents, current: Documents) -> DataFrame:
    """Both sides' counts of each template and field they share."""
    full = lambda d, p: histograms.ordinal_histograms(d.ordinals).select(*KEYS, "template_id", "field_name", *[F.col(c).alias(f"{p}_{c}") for c in ("schedule", "counts", "total")])
    return full(previous, "previous").join(full(current, "current"), [*KEYS, "template_id", "field_name"])


def tail_delta(previous: Documents, current: Documents) -> DataFrame:
    """Tail summaries where both sides have one."""
    names = ("tail_unique", "tail_entropy_bits", "tail_max_rate")
    side = lambda d, p: d.header.where("tail_unique > 0").select(*KEYS, *[F.col(c).alias(f"{p}_{c}") for c in names])
    both = side(previous, "previous").join(side(current, "current"), KEYS)
    return both.select("*", *[(F.col(f"current_{c}") - F.col(f"previous_{c}")).alias(f"{c}_delta") for c in names])


def reservoir_delta(previous: Documents, current: Documents) -> DataFrame:
    """Reservoir entries that the other side doesn't retain at all, and templates that crossed into failure or out of it."""
    pairs = previous.header.where("reservoir_size is not null").select(*KEYS).join(current.header.where("reservoir_size is not null").select(*KEYS), KEYS)
    fields = ["level", "count", "frequency", "role", "salience"]
    a = previous.rows.join(pairs, KEYS, "left_semi").select(*KEYS, "template_id", *[F.col(c).alias(f"previous_{c}") for c in (*fields, "block")])
    b = current.rows.join(pairs, KEYS, "left_semi").select(*KEYS, "template_id", *[F.col(c).alias(f"current_{c}") for c in (*fields, "block")])
    both = a.join(b, [*KEYS, "template_id"], "full")
    was, now = is_failure(F.col("previous_level")), is_failure(F.col("current_level"))
    kind = F.when((F.col("previous_block").isNull()) & (F.col("current_block") == "reservoir"), "new_salient").when(F.col("current_block").isNull() & (F.col("previous_block") == "reservoir"), "vanished_salient")
    kind = kind.when(F.col("previous_block").isNotNull() & F.col("current_block").isNotNull() & (was != now), F.when(now, "crossed_up").otherwise("crossed_down"))
    return both.withColumn("kind", kind).where("kind is not null").select(*KEYS, "kind", "template_id", row_level_token(F.col("previous_level")).alias("previous_level"), row_level_token(F.col("current_level")).alias("current_level"), "previous_count", "current_count", "previous_frequency", "current_frequency", "previous_role", "current_role", "previous_salience", "current_salience")


def latency_shifts(previous: Documents, current: Documents) -> DataFrame:
    """Drift of each component's durations, over the top lists, where both sides have the floor of samples. Ordinals of
    other schedules take no part."""
    drift = histograms.w1_shift(histograms.component_durations(previous.ordinals), histograms.component_durations(current.ordinals), [*KEYS, "component"])
    return drift.withColumn("latency_shift", shift_label(F.col("shift"), F.col("direction")))


def common_states(previous: Documents, current: Documents) -> DataFrame:
    """The coarser collapse of the two."""
    a, b = (d.states.select(*KEYS, F.col("band_floor").alias(f"b{i}"), F.col("floor_depth").alias(f"d{i}")) for i, d in enumerate((previous, current)))
    return a.join(b, KEYS).select(*KEYS, F.greatest("b0", "b1").alias("band_floor"), F.least("d0", "d1").alias("floor_depth"))


def cube_diff(previous: Documents, current: Documents) -> DataFrame:
    """Emerging and vanishing borders at the coarser collapse of the two; components with a latency shift carry it as a
    fourth dimension on the current side alone."""
    common = common_states(previous, current).select(*KEYS, F.col("band_floor").alias("_b"), F.col("floor_depth").alias("_d"))
    fit = lambda d: cube.coarsen(d.joint.join(common, KEYS), F.col("_b"), F.col("_d"))
    before, after = fit(previous).withColumn("latency_shift", F.lit(None).cast("string")), fit(current)
    if previous.ordinals is not None and current.ordinals is not None:
        shifts = latency_shifts(previous, current).where("shift != 'None' and direction != 'None'").select(*KEYS, "component", "latency_shift")
        after = after.join(shifts, [*KEYS, "component"], "left").select(*before.columns)
    else:
        after = after.withColumn("latency_shift", F.lit(None).cast("string")).select(*before.columns)
    dims = [*cube.DIMS, "latency_shift"]
    emerging = cube.border(before, after, KEYS, dims).withColumn("direction", F.lit("emerging"))
    return emerging.unionByName(cube.border(before, after, KEYS, dims, mono="previous").withColumn("direction", F.lit("vanishing")))


def incomparable(previous: Documents, current: Documents) -> DataFrame:
    """(pair, signal, reason, block, absent_in) of comparisons that were not made; absence comes before order and caps."""
    h = diff_header(previous.header, current.header)
    out = []

    def state(signal: str, block: str, p, c, other=None, reason: str | None = None) -> None:
        absent = F.when(p & ~c, "current").when(~p & c, "previous")
        why = F.when(absent.isNotNull(), "absent_in_one_input")
        if other is not None:
            why = why.when(p & c & other, reason)
        out.append(F.struct(F.lit(signal).alias("signal"), why.alias("reason"), F.when(why == "absent_in_one_input", block).alias("block"), absent.alias("absent_in")))

    behaves = lambda s: F.col(f"{s}.ngram_size").isNotNull()
    sizes = F.col("l.ngram_size") != F.col("r.ngram_size")
    state("ngram_delta", "behavior", behaves("l"), behaves("r"), sizes, "ngram_size_differs")
    state("branching_delta", "behavior.branching", behaves("l") & F.lit(previous.branching is not None), behaves("r") & F.lit(current.branching is not None), sizes, "ngram_size_differs")
    tracks = lambda s: F.col(f"{s}.param_histograms_size").isNotNull()
    caps = (F.col("l.param_histograms_size") != F.col("r.param_histograms_size")) | (F.col("l.value_counts_size") != F.col("r.value_counts_size"))
    state("field_histogram_deltas", "param_histograms", tracks("l"), tracks("r"), caps, "histogram_caps_differ")
    state("reservoir_delta", "stats.reservoir", F.col("l.reservoir_size").isNotNull(), F.col("r.reservoir_size").isNotNull())
    state("cube_diff", "cube", F.lit(previous.joint is not None), F.lit(current.joint is not None))
    return h.select(*KEYS, F.explode(F.array(*out)).alias("s")).select(*KEYS, "s.*").where("reason is not null")


@dataclass(frozen=True)
class Diff:
    header: DataFrame
    divergence: DataFrame
    templates: DataFrame
    tail: DataFrame
    reservoir: DataFrame
    incomparable: DataFrame
    ngrams: DataFrame | None = None
    branching: DataFrame | None = None
    fields: DataFrame | None = None
    ordinals: DataFrame | None = None
    service: DataFrame | None = None
    span_edges: DataFrame | None = None
    cube: DataFrame | None = None
    states: DataFrame | None = None


def diff(previous: Documents, current: Documents) -> Diff:
    both = lambda name: getattr(previous, name) is not None and getattr(current, name) is not None
    return Diff(
        header=diff_header(previous.header, current.header), divergence=divergence(previous, current), templates=template_deltas(previous, current), tail=tail_delta(previous, current), reservoir=reservoir_delta(previous, current), incomparable=incomparable(previous, current),
        ngrams=ngram_delta(previous, current) if both("ngrams") else None, branching=branching_delta(previous, current) if both("branching") else None,
        fields=field_histogram_deltas(previous, current) if both("values") else None, ordinals=ordinal_histogram_deltas(previous, current) if both("ordinals") else None,
        service=edge_delta(previous.service, current.service, ["caller", "callee"], True) if both("service") else None,
        span_edges=edge_delta(previous.span_edges, current.span_edges, ["parent_template", "child_template"], False) if both("span_edges") else None,
        cube=cube_diff(previous, current) if both("joint") else None, states=common_states(previous, current) if both("joint") else None)


def outcome(d: Diff) -> DataFrame:
    """(pair, comparison_outcome, withheld_signals): changed if any witness moved. Service and span edges, ordinals and
    incomparable signals are no witnesses; a moved histogram slot is one, and is named as withheld."""
    witness = lambda frame, cond, name: frame.where(cond).select(*KEYS, F.lit(name).alias("w"))
    found = [
        witness(d.divergence, "kl_divergence != 0 or js_divergence != 0 or stability_score != 1", "divergence"), witness(d.templates, "delta != 0 or state != 'common'", "template_deltas"),
        witness(d.tail, "tail_unique_delta != 0 or tail_entropy_bits_delta != 0 or tail_max_rate_delta != 0", "tail_delta"), witness(d.reservoir, "true", "reservoir_delta"),
    ]
    for frame, cond, name in ((d.ngrams, "true", "ngram_delta"), (d.branching, "true", "branching_delta"), (d.cube, "true", "cube_diff"), (d.fields, "moved", "field_histogram_deltas")):
        if frame is not None:
            found.append(witness(frame, cond, name))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    seen = every.groupBy(*KEYS).agg(F.collect_set("w").alias("w"))
    out = d.divergence.select(*KEYS, "kl_divergence", "js_divergence").join(seen, KEYS, "left")
    withheld = F.when(F.array_contains("w", "field_histogram_deltas"), F.array(F.lit("field_histogram_deltas"))).otherwise(F.array().cast("array<string>"))
    return out.select(*KEYS, F.when(F.coalesce(F.size("w"), F.lit(0)) > 0, "changed").otherwise("unchanged").alias("comparison_outcome"), withheld.alias("withheld_signals"), F.array_sort(F.coalesce("w", F.array().cast("array<string>"))).alias("witnesses"))


def to_json(d: Diff, vendor: str = "") -> DataFrame:
    """(source, window_id, json): the diff on the wire, with its outcome; absent members are omitted, histogram rows are
    withheld. ``vendor`` begins the names of members that are extensions."""
    out = d.header.join(outcome(d), KEYS).join(d.divergence, KEYS)
    safe = lambda c, path=None, at=None: finite_or_fail(F.col(c), path or c, at).alias(c)
    id_ = [F.col("template_id")]
    entry = F.struct("template_id", F.coalesce("previous_count", F.lit(0)).alias("previous_count"), F.coalesce("current_count", F.lit(0)).alias("current_count"), "delta", "previous_frequency", "current_frequency")
    lists = [_list(d.templates.where("state = 'common' and delta != 0"), [F.abs("delta") * -1, *id_], entry, "template_deltas")]
    lists += [_list(d.templates.where(F.col("state") == n), [F.abs("delta") * -1, *id_], F.col("template_id"), f"{n}_templates") for n in ("new", "vanished")]
    if d.branching is not None:
        lists.append(_list(d.branching, [F.col("rank")], F.struct("template_id", safe("previous_entropy_bits", "branching_delta[].previous_entropy_bits", F.col("rank") - 1), safe("current_entropy_bits", "branching_delta[].current_entropy_bits", F.col("rank") - 1), safe("delta_bits", "branching_delta[].delta_bits", F.col("rank") - 1)), "branching_delta"))
    if d.ngrams is not None:
        lists += [_list(d.ngrams.where(F.col("state") == n), [F.col("ids")], F.col("ids"), f"{n}_ngrams") for n in ("new", "vanished")]
        lists.append(_list(d.ngrams.where("state = 'rate_changed'"), [F.col("rank")], F.struct(F.col("ids").alias("sequence"), "previous_probability", "current_probability", "delta"), "rate_changed"))
    names = {"tail_unique": "tail_template_count", "tail_entropy_bits": "tail_entropy_bits", "tail_max_rate": "tail_max_rate"}
    lists.append(d.tail.select(*KEYS, F.struct(*[F.col(f"{side}_{c}").alias(f"{side}_{n}") for c, n in names.items() for side in ("previous", "current")], *[F.col(f"{c}_delta").alias(f"{n}_delta") for c, n in names.items()]).alias("tail_delta")))
    for kind, side in (("new_salient", "current"), ("vanished_salient", "previous")):
        held = F.struct("template_id", F.col(f"{side}_level").alias("level"), F.when(F.col(f"{side}_role") > 0, role_name(F.col(f"{side}_role"))).alias("structural_role"), F.coalesce(f"{side}_salience", F.lit(0)).alias("salience"), F.col(f"{side}_count").alias("count"))
        lists.append(_list(d.reservoir.where(F.col("kind") == kind), id_, held, kind))
    crossed = d.reservoir.where("kind like 'crossed%'")
    lists.append(_list(crossed, id_, F.struct("template_id", F.when(F.col("kind") == "crossed_up", "up").otherwise("down").alias("direction"), "previous_level", "current_level"), "frontier_crossings"))
    if d.cube is not None:
        stored = F.when(F.col("direction") == "emerging", F.col("count")).otherwise(F.lit(0))
        gone = F.when(F.col("direction") == "vanishing", F.col("count")).otherwise(F.lit(0))
        cell = F.struct(coordinate(F.col("level"), F.col("component"), F.col("role"), F.col("latency_shift")).alias("coord"), gone.alias("previous_count"), stored.alias("current_count"))
        order = [F.col("pinned"), F.coalesce("level", F.lit(99)), F.col("component").isNull(), F.coalesce("component", F.lit("")), F.coalesce("role", F.lit(99)), F.coalesce("latency_shift", F.lit("~"))]
        lists += [_list(d.cube.where((F.col("direction") == x) & (F.col("side") == y)), order, cell, f"_{x}_{y}") for x in ("emerging", "vanishing") for y in ("lower", "upper")]
        lists += [d.cube.groupBy(*KEYS).agg(F.max(F.col("latency_shift").isNotNull()).alias("_shifted")), d.states]
    if d.service is not None:
        edge = lambda c: F.struct("caller", "callee", F.col(c).alias("weight"))
        ends = [F.col("caller"), F.col("callee")]
        lists += [_list(d.service.where("state = 'new'"), ends, edge("current_count"), "emerged"), _list(d.service.where("state = 'vanished'"), ends, edge("previous_count"), "_gone")]
        lists.append(_list(d.service.where("state = 'changed'"), ends, F.struct("caller", "callee", F.col("previous_count").alias("previous_weight"), F.col("current_count").alias("current_weight"), (F.col("current_count") - F.col("previous_count")).alias("delta")), "weight_changed"))
    if d.span_edges is not None:
        ends = [F.col("parent_template"), F.col("child_template")]
        lists += [_list(d.span_edges.where(F.col("state") == n), ends, F.struct(F.col("parent_template").alias("parent"), F.col("child_template").alias("child"), F.col(f"{side}_count").alias("count")), f"{n}_edges") for n, side in (("new", "current"), ("vanished", "previous"))]
    why = d.incomparable.groupBy(*KEYS).agg(*[F.max(F.when(F.col("signal") == n, F.struct("reason", "absent_in", "block"))).alias(f"_why_{n}") for n in SIGNALS])
    for block in (*lists, why):
        out = out.join(block, KEYS, "left")
    has = lambda c: F.col(c) if c in out.columns else F.lit(None)
    some = lambda *names_: reduce(lambda a, b: a | b, [has(n).isNotNull() for n in names_])
    ref = lambda s: F.struct(F.struct(*window_wire(F.col(f"{s}.start"), F.col(f"{s}.end"))).alias("window"))
    sizes = {"ngram_size_differs": ("ngram_size",), "histogram_caps_differ": ("param_histograms_size", "value_counts_size")}

    def stated(signal: str) -> Column:
        x = F.col(f"_why_{signal}")
        evidence = [F.when(x["reason"] == reason, F.col(f"{s}.{c}")).alias(f"{side}_{c}") for reason, cols in sizes.items() for c in cols for s, side in (("l", "previous"), ("r", "current"))]
        return F.when(x.isNotNull(), F.struct(x["reason"].alias("reason"), x["absent_in"].alias("absent_in"), x["block"].alias("block"), *evidence)).alias(signal)

    ngrams = F.when(some("new_ngrams", "vanished_ngrams", "rate_changed"), F.struct(F.col("l.ngram_size").alias("ngram_size"), has("new_ngrams").alias("new_ngrams"), has("vanished_ngrams").alias("vanished_ngrams"), has("rate_changed").alias("rate_changed")))
    reservoir = F.when(some("new_salient", "vanished_salient", "frontier_crossings"), F.struct(*[has(n).alias(n) for n in ("new_salient", "vanished_salient", "frontier_crossings")]))
    cubes = F.lit(None)
    if d.cube is not None:
        empty = lambda c: F.coalesce(F.col(c), F.array()).alias(c.rsplit("_", 1)[1])
        side = lambda n: F.when(some(f"_{n}_lower", f"_{n}_upper"), F.struct(empty(f"_{n}_lower"), empty(f"_{n}_upper"))).alias(n)
        plain, shifted = axes(F.col("band_floor"), F.col("floor_depth")), axes(F.col("band_floor"), F.col("floor_depth"), True)
        cubes = F.when(some(*[f"_{n}_{s}" for n in ("emerging", "vanishing") for s in ("lower", "upper")]), F.struct(F.when(F.coalesce("_shifted", F.lit(False)), shifted).otherwise(plain).alias("axes"), side("emerging"), side("vanishing")))
    service = F.struct(has("emerged").alias("emerged"), has("_gone").alias("vanished"), has("weight_changed").alias("weight_changed")) if d.service is not None else F.lit(None)
    spans = F.when(some("new_edges", "vanished_edges"), F.struct(has("new_edges").alias("new_edges"), has("vanished_edges").alias("vanished_edges"))) if d.span_edges is not None else F.lit(None)
    extensions = F.when(service.isNotNull() | spans.isNotNull(), F.struct(service.alias(f"{vendor}service_edge_delta"), spans.alias(f"{vendor}span_edge_delta")))
    document = F.struct(
        F.lit(VERSION).alias("diff_version"), ref("l").alias("previous"), ref("r").alias("current"), "comparison_outcome", F.col("l.max_text_bytes").alias("max_text_bytes"), safe("kl_divergence"), safe("js_divergence"), safe("stability_score"),
        *[has(n).alias(n) for n in ("template_deltas", "new_templates", "vanished_templates", "branching_delta")], ngrams.alias("ngram_delta"), has("tail_delta").alias("tail_delta"), cubes.alias("cube_diff"), reservoir.alias("reservoir_delta"),
        F.when(F.size("withheld_signals") > 0, F.col("withheld_signals")).alias("withheld_signals"), F.when(some(*[f"_why_{n}" for n in SIGNALS]), F.struct(*[stated(n) for n in SIGNALS])).alias("incomparable_signals"), extensions.alias("extensions"))
    return out.select(*KEYS, F.to_json(document, {"ignoreNullFields": "true"}).alias("json"))
