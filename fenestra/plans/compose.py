"""Composition of two documents into a coarser one: commutative, not associative, so several are folded in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import KEYS, UNKNOWN, VERSION
from ..functions.stats import entropy_bits, salience
from ..functions.text import carry_equal, level_token, role_name
from ..operators import churn, cube, histograms
from ..operators.order import ranked
from ..sources.shared import materialise
from .documents import PROVENANCE, SOURCE, Documents, coordinate_wire, source_wire, window_wire

GATES = ("canonicalization_version", "retention_profile")


def gates(l: DataFrame, r: DataFrame, operation: str) -> DataFrame:
    """Pairs of headers as structs l and r; the pair fails where the text caps differ (declared against absent counts) or
    both sides declare different processing identifiers."""
    pairs = l.select(*KEYS, F.struct(*l.columns).alias("l")).join(r.select(*KEYS, F.struct(*r.columns).alias("r")), KEYS)
    bad = F.when(~F.col("l.max_text_bytes").eqNullSafe(F.col("r.max_text_bytes")), F.lit(f"{operation}: max_text_bytes differ"))
    for g in GATES:
        bad = bad.when(F.col(f"l.{g}") != F.col(f"r.{g}"), F.lit(f"{operation}: {g} differ"))
    for side in "lr":
        start, end = F.col(f"{side}.start"), F.col(f"{side}.end")
        bad = bad.when((start.isNull() != end.isNull()) | F.coalesce(end < start, F.lit(False)), F.lit(f"{operation}: malformed window bounds"))
    # the check must survive column pruning, so it guards the window id
    return pairs.withColumn("window_id", F.when(bad.isNull(), F.col("window_id")).otherwise(F.raise_error(bad).cast("long")))


def resolve(a: Column, na: Column, b: Column, nb: Column, name: Column | None = None, name_b: Column | None = None) -> Column:
    """A label of two inputs: a present one wins, then the one of the higher count, then the smaller spelling."""
    x, y = (a, b) if name is None else (name, name_b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(na > nb, a).when(nb > na, b).when(x <= y, a).otherwise(b)


def merged_rows(l: DataFrame, r: DataFrame) -> DataFrame:
    """The union of the retained templates: summed counts and resolved labels, with each side's churn."""
    side = lambda d, p: d.select(*KEYS, "template_id", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "count", "level", "level_declared", "component", "role", "surprise", "novelty", "churn")])
    both = side(l, "l").join(side(r, "r"), [*KEYS, "template_id"], "full")
    nl, nr = F.coalesce("l_count", F.lit(0)), F.coalesce("r_count", F.lit(0))
    known = lambda p: F.when(F.col(f"{p}_level") != UNKNOWN, F.col(f"{p}_level"))
    role = lambda p: F.when(F.col(f"{p}_role") > 0, F.col(f"{p}_role"))
    level = resolve(known("l"), nl, known("r"), nr, level_token(known("l")), level_token(known("r")))
    declared = F.when(known("l").isNull(), F.col("r_level_declared")).when(known("r").isNull(), F.col("l_level_declared")).when(known("l") == known("r"), F.col("l_level_declared") | F.col("r_level_declared")).when(level == known("l"), F.col("l_level_declared")).otherwise(F.col("r_level_declared"))
    return both.select(
        *KEYS, "template_id", (nl + nr).alias("count"), F.coalesce(level, F.lit(UNKNOWN)).alias("level"), F.coalesce(declared, F.lit(False)).alias("level_declared"), resolve(F.col("l_component"), nl, F.col("r_component"), nr).alias("component"),
        F.coalesce(resolve(role("l"), nl, role("r"), nr, role_name(role("l")), role_name(role("r"))), F.lit(0)).alias("role"),
        F.greatest(F.coalesce("l_surprise", F.lit(0)), F.coalesce("r_surprise", F.lit(0))).alias("surprise"), F.greatest(F.coalesce("l_novelty", F.lit(0)), F.coalesce("r_novelty", F.lit(0))).alias("novelty"),
        (F.coalesce(F.col("l_block") == "reservoir", F.lit(False)) | F.coalesce(F.col("r_block") == "reservoir", F.lit(False))).alias("salient"), "l_churn", "r_churn")


def merged_ngrams(l: DataFrame, r: DataFrame) -> DataFrame:
    """Counts added by sequence; probability is the count over the prefixes' totals of the inputs that have the key."""
    both = l.select(*KEYS, "ids", "count", "probability").unionByName(r.select(*KEYS, "ids", "count", "probability"))
    prefix = F.sum(F.when(F.col("count") > 0, F.col("count") / F.col("probability")))
    agg = both.groupBy(*KEYS, "ids").agg(F.sum("count").alias("count"), prefix.alias("_p"))
    agg = agg.withColumn("probability", F.when(F.col("count") > 0, F.col("count") / F.col("_p")).otherwise(0.0)).drop("_p")
    return ranked(agg, "rank", [F.col("count").desc(), F.col("ids")])


def common_tags(a: Column, b: Column) -> Column:
    """Tags that both sources have with equal values."""
    return F.map_filter(a, lambda k, v: F.element_at(b, k).eqNullSafe(v))


def merged_source(a: Column, b: Column) -> Column:
    """:func:`common_source` for headers' blocks, whose tags are sorted pairs."""
    with_map = lambda x: F.struct(*[x[c].alias(c) for c in ("service", "fleet", "host_count", "host")], F.map_from_entries(x["tags"]).alias("tags"))
    m = common_source(with_map(a), with_map(b), ["service", "fleet", "host"])
    return F.struct(m["service"].alias("service"), m["fleet"].alias("fleet"), m["host_count"].alias("host_count"), m["host"].alias("host"), F.array_sort(F.map_entries(m["tags"])).alias("tags")).cast(SOURCE)


def provenance_entry(side: str) -> Column:
    """One input, as an entry of the result's provenance: by window start (none first), end, then the bytes of its
    canonical JSON, whose members are in alphabetical order."""
    c = lambda name: F.col(f"{side}.{name}")
    start, end = window_wire(c("start"), c("end"))
    wire = F.struct(coordinate_wire(c("coordinate"), F.lit(None).cast("string")).alias("coordinate"), c("lines").alias("lines_observed"), source_wire(c("source_block")).alias("source"), F.struct(end, start).alias("window"))
    return F.struct(c("start").alias("start"), c("end").alias("end"), F.to_json(wire, {"ignoreNullFields": "true"}).alias("json"), c("source").alias("source"), c("source_block").alias("source_block"), c("lines").alias("lines"), c("coordinate").alias("coordinate"))


def common_source(a: Column, b: Column, scalars: list[str], counts: str = "host_count", tags: str = "tags") -> Column:
    """Equal sources as they are; else equal scalars, summed host counts and common tags."""
    mixed = F.struct(*[carry_equal(a[s], b[s]).alias(s) for s in scalars], (a[counts] + b[counts]).alias(counts), common_tags(a[tags], b[tags]).alias(tags))
    same = F.struct(*[a[s].alias(s) for s in scalars], a[counts].alias(counts), a[tags].alias(tags))
    equal = reduce(lambda x, y: x & y, [a[s].eqNullSafe(b[s]) for s in [*scalars, counts]]) & F.array_sort(F.map_entries(a[tags])).eqNullSafe(F.array_sort(F.map_entries(b[tags])))
    return F.when(equal, same).otherwise(mixed)


def _key(x: Column) -> Column:
    return F.struct(x["start"], x["end"], x["json"])


def _header(l: DataFrame, r: DataFrame) -> DataFrame:
    h = gates(l, r, "compose")
    c = lambda side, name: F.col(f"{side}.{name}")
    least = lambda name: F.least(c("l", name), c("r", name))
    plus = lambda name: F.coalesce(c("l", name), F.lit(0)) + F.coalesce(c("r", name), F.lit(0))
    l_first = (c("l", "end") <= c("r", "start")) & (c("l", "start") < c("r", "start"))
    r_first = (c("r", "end") <= c("l", "start")) & (c("r", "start") < c("l", "start"))
    order = F.when(l_first, "l").when(r_first, "r").otherwise("none")
    span = F.when(order == "none", F.greatest(c("l", "span_windows"), c("r", "span_windows"))).otherwise(plus("span_windows"))
    ngram_size = F.when(c("l", "ngram_size").isNull(), c("r", "ngram_size")).when(c("r", "ngram_size").isNull() | (c("l", "ngram_size") == c("r", "ngram_size")), c("l", "ngram_size"))
    given = F.concat(F.array(provenance_entry("l")), F.array(provenance_entry("r"))).cast(PROVENANCE)
    in_order = lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0)
    provenance = F.array_sort(F.concat(c("l", "provenance"), c("r", "provenance"), given), in_order)
    missing = ((c("l", "lines") > 0) & c("l", "coordinate").isNull()) | ((c("r", "lines") > 0) & c("r", "coordinate").isNull())
    leaves = F.array_sort(F.concat(F.coalesce(c("l", "coordinate"), F.array()), F.coalesce(c("r", "coordinate"), F.array())), lambda a, b: F.when(a["start_ticks"] < b["start_ticks"], -1).when(a["start_ticks"] > b["start_ticks"], 1).when(a["end_ticks"] < b["end_ticks"], -1).when(a["end_ticks"] > b["end_ticks"], 1).when(a["ref"] < b["ref"], -1).when(a["ref"] > b["ref"], 1).otherwise(0))
    return h.select(
        *KEYS, least("start").alias("start"), F.greatest(c("l", "end"), c("r", "end")).alias("end"), (c("l", "lines") + c("r", "lines")).alias("lines"), least("top_k_size").alias("top_k_size"), least("reservoir_size").alias("reservoir_size"),
        ngram_size.alias("ngram_size"), least("top_ngrams_size").alias("top_ngrams_size"), plus("dropped_ngram_observations").alias("dropped_ngram_observations"), F.lit(None).cast("long").alias("graph_edge_count"),
        least("param_histograms_size").alias("param_histograms_size"), F.when(c("l", "param_histograms_size").isNotNull() | c("r", "param_histograms_size").isNotNull() | c("l", "value_counts_size").isNotNull() | c("r", "value_counts_size").isNotNull(), F.coalesce(least("value_counts_size"), F.lit(64))).alias("value_counts_size"),
        *[carry_equal(c("l", g), c("r", g)).alias(g) for g in (*GATES, "ruleset", "transport")], c("l", "max_text_bytes").alias("max_text_bytes"), F.lit(VERSION).alias("producer_version"), F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("run_outcome"),
        span.cast("int").alias("span_windows"), order.alias("_order"), plus("tail_count").alias("_residual"), F.when(~F.coalesce(missing, F.lit(False)), F.when(F.size(leaves) > 0, leaves)).alias("coordinate"), provenance.alias("provenance"), merged_source(c("l", "source_block"), c("r", "source_block")).alias("source_block"),
        c("l", "span_windows").alias("_l_span"), c("r", "span_windows").alias("_r_span"), *[((c(s, "tail_count") == 0) & (c(s, "tail_unique") == 0)).alias(f"_{s}_all") for s in "lr"])


def compose(l: Documents, r: Documents) -> Documents:
    """Documents of ``l`` and ``r`` that have the same source and window_id become one. Templates, n-grams, histograms and
    cubes merge; the reservoir is scored anew over the merged counts; stability, acquisition, edges between services and
    spans, branching, paths and ordinals are dropped."""
    head = materialise(_header(l.header, r.header), "header")
    rows = ranked(merged_rows(l.rows, r.rows), "rank", [F.col("count").desc(), F.col("template_id")]).join(head.select(*KEYS, "lines", "top_k_size", "reservoir_size", "_order", "_l_span", "_r_span", "_l_all", "_r_all", "_residual"), KEYS)
    absent = lambda s: churn.unretained(F.col(f"_{s}_span"), F.col(f"_{s}_all"))
    lc, rc = (F.coalesce(F.col(f"{s}_churn"), absent(s)) for s in "lr")
    folded = F.when(F.col("_order") == "l", churn.product(lc, rc)).when(F.col("_order") == "r", churn.product(rc, lc)).otherwise(churn.join(lc, rc))
    score, axis = salience(F.col("level"), F.col("role"), F.lit(False), F.col("count"), F.col("lines"), F.col("surprise"), F.col("novelty"))
    rows = rows.withColumns({"churn": folded, "salience": score, "retention_axis": axis, "frequency": F.col("count") / F.col("lines"), "within_window_ordinal": F.lit(None).cast("long")})
    keep = rows.withColumn("block", F.when(F.col("rank") <= F.col("top_k_size"), "top").when(F.col("salient") & (F.col("salience") > 0), "reservoir"))
    keep = ranked(keep, "_slot", [F.col("salience").desc(), F.col("template_id")], [*KEYS, "block"])
    keep = keep.withColumn("block", F.when((F.col("block") == "reservoir") & (F.col("_slot") > F.col("reservoir_size")), None).otherwise(F.col("block")))
    keep = materialise(keep.withColumn("place", F.when(F.col("block") == "top", F.col("rank")).when(F.col("block") == "reservoir", F.col("_slot"))), "templates")
    null_top = lambda c, t: F.when(F.col("block") == "reservoir", F.col(c)).cast(t).alias(c)
    retained = keep.where("block is not null").select(*KEYS, "block", "place", "template_id", "count", "frequency", "level", "level_declared", "component", "role", null_top("surprise", "int"), null_top("novelty", "int"), null_top("salience", "int"), null_top("retention_axis", "string"), "within_window_ordinal", "churn")
    rest = keep.where("block is null").groupBy(*KEYS).agg(F.sum("count").alias("_t"), F.count("*").alias("tail_unique"), F.max("count").alias("_m"), F.collect_list("count").alias("_counts"))
    head = head.join(rest, KEYS, "left")
    mass = F.coalesce("_t", F.lit(0)) + F.col("_residual")
    entropy = lambda counts, total: F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * (F.log2(total) - F.log2(x)) / total)
    tails = F.concat("_counts", F.array(F.col("_residual")))
    totals = keep.groupBy(*KEYS).agg(entropy_bits(F.col("count"), F.col("lines")).alias("_e"), F.count("*").alias("unique_templates"))
    head = head.join(totals, KEYS, "left")
    left = F.col("_residual")
    head = head.withColumns({
        "tail_count": mass, "tail_unique": F.coalesce("tail_unique", F.lit(0)), "tail_entropy_bits": F.when(F.size("_counts") > 0, entropy(tails, mass)), "tail_max_rate": F.col("_m") / F.col("lines"),
        "entropy_bits": F.when(F.col("lines") > 0, F.col("_e") + F.when(left > 0, left * (F.log2("lines") - F.log2(left)) / F.col("lines")).otherwise(0.0))})
    ngrams = None
    if l.ngrams is not None or r.ngrams is not None:
        a, b = l.ngrams if l.ngrams is not None else r.ngrams.limit(0), r.ngrams if r.ngrams is not None else l.ngrams.limit(0)
        ngrams = merged_ngrams(a, b).join(head.select(*KEYS, "top_ngrams_size", "ngram_size"), KEYS).where("ngram_size is not null and rank <= top_ngrams_size").drop("top_ngrams_size", "ngram_size")
    slots = values = None
    if l.values is not None or r.values is not None:
        slots, values = _slots(l, r, head, retained)
    joint = states = None
    if l.joint is not None and r.joint is not None:
        joint, states = _cubes(l, r)
    registry = None if l.registry is None or r.registry is None else l.registry.unionByName(r.registry).groupBy("template_id").agg(F.min("template_str").alias("template_str"))
    header = materialise(head.drop("_order", "_residual", "_l_span", "_r_span", "_l_all", "_r_all", "_t", "_m", "_counts", "_e"), "header")
    return Documents(header=header, rows=retained, ngrams=ngrams, slots=slots, values=values, joint=joint, states=states, registry=registry)


def _slots(l: Documents, r: Documents, head: DataFrame, retained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histogram slots below the smaller slot cap: values' counts add up, the largest re-enter up to the value cap."""
    sides = [d.values.where("admitted") for d in (l, r) if d.values is not None]
    every = reduce(DataFrame.unionByName, [s.select(*histograms.SLOT, "value", "count") for s in sides]).groupBy(*histograms.SLOT, "value").agg(F.sum("count").alias("count"))
    caps = head.select(*KEYS, "param_histograms_size", "value_counts_size")
    top = retained.where("block = 'top'").select(*KEYS, "template_id")
    every = every.join(top, [*KEYS, "template_id"], "left_semi").join(caps, KEYS).where("param_histograms_size is null or param_index < param_histograms_size")
    values = ranked(every, "_r", [F.col("count").desc(), F.col("value")], histograms.SLOT).withColumn("admitted", F.col("_r") <= F.col("value_counts_size"))
    seen = reduce(DataFrame.unionByName, [d.slots.select(*histograms.SLOT, "total", "cardinality") for d in (l, r) if d.slots is not None])
    sums = seen.groupBy(*histograms.SLOT).agg(F.sum("total").alias("total"), F.max("cardinality").alias("_c"))
    merged = values.groupBy(*histograms.SLOT).agg(F.count("*").alias("_k"), F.count_if("admitted").alias("kept_values"), F.sum(F.when(F.col("admitted"), F.col("count")).otherwise(0)).alias("kept_count"))
    slots = sums.join(merged, histograms.SLOT).withColumn("cardinality", F.when(F.col("_c") > 0, F.greatest("_c", "_k"))).drop("_c", "_k")
    bits = values.where("admitted").join(slots.select(*histograms.SLOT, "total"), histograms.SLOT).groupBy(*histograms.SLOT).agg(entropy_bits(F.col("count"), F.col("total")).alias("entropy_bits"))
    return slots.join(bits, histograms.SLOT, "left"), values.select(*histograms.SLOT, "value", "count", "admitted")


def _cubes(l: Documents, r: Documents) -> tuple[DataFrame, DataFrame]:
    """Bases added at the coarser of both collapse states, then collapsed further where that is over the budget."""
    a, b = (d.states.select(*KEYS, F.col("band_floor").alias(f"b{i}"), F.col("floor_depth").alias(f"d{i}")) for i, d in enumerate((l, r)))
    common = a.join(b, KEYS).select(*KEYS, F.greatest("b0", "b1").alias("band_floor"), F.least("d0", "d1").alias("floor_depth"))
    summed = l.joint.select(*KEYS, *cube.DIMS, "count").unionByName(r.joint.select(*KEYS, *cube.DIMS, "count")).join(common, KEYS)
    joint = materialise(cube.coarsen(summed, F.col("band_floor"), F.col("floor_depth")), "joint")
    again = cube.collapse_states(joint).select(*KEYS, F.col("band_floor").alias("b"), F.col("floor_depth").alias("d"))
    states = common.join(again, KEYS).select(*KEYS, F.greatest("band_floor", "b").alias("band_floor"), F.least("floor_depth", "d").alias("floor_depth"))
    states = materialise(states, "states")
    return materialise(cube.coarsen(joint.join(states, KEYS), F.col("band_floor"), F.col("floor_depth")), "joint"), states


def fold(docs: Documents, windows: list[int]) -> Documents:
    """Several windows of every source, composed from the first to the last; the order is part of the result."""
    parts = [docs.at(f"CASE WHEN window_id = {w} THEN 0 END") for w in windows]
    return reduce(compose, parts)
