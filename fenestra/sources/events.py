"""Sources of canonical events: adapters, readers, registry and admission.

A canonical event has source, window_id, seq (the order within a window), ts, template_str, template_id, level,
declared_level, echoed_source, role, component (null: unlocated), params, ordinals, trace_id, is_span, span_id,
parent_span_id and linked_span_ids; params_original has the parameters as they came, which sketches hash, and text_cap the
cap that component and params have been put under, null for none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import KEYS, NONE, TERMINATOR
from ..functions.text import cap_text, level_of, role_of, template_id, well_formed
from .shared import materialise

ORDINAL_TYPE = "array<struct<field_name:string,schedule:string,value:bigint>>"
DEFAULTS = {
    "source": ("string", "events"), "declared_level": ("boolean", False), "echoed_source": ("boolean", False), "role": ("int", NONE), "component": ("string", None),
    "params": ("array<string>", None), "ordinals": (ORDINAL_TYPE, None), "trace_id": ("bigint", None), "is_span": ("boolean", False), "span_id": ("bigint", None),
    "parent_span_id": ("bigint", None), "linked_span_ids": ("array<bigint>", None), "ts": ("timestamp", None), "level": ("int", 2), "window_id": ("bigint", 0),
}


def canonical(rows: DataFrame, max_text_bytes: int | None = None) -> DataFrame:
    """``rows`` (seq, template_str and any other event columns) as canonical events: missing columns get their defaults,
    text is repaired and, if asked, capped before anything groups by it; an empty component is none."""
    cols = {c: (F.col(c).cast(t) if c in rows.columns else F.lit(v).cast(t)) for c, (t, v) in DEFAULTS.items()}
    capped = (lambda c: cap_text(well_formed(c), max_text_bytes)) if max_text_bytes else well_formed
    cols["component"] = capped(F.nullif(cols["component"], F.lit("")))
    cols |= {"params_original": cols["params"], "text_cap": F.lit(max_text_bytes).cast("int")}
    cols["params"] = F.transform(cols["params"], capped)
    cols |= {"seq": F.col("seq").cast("long"), "template_str": F.col("template_str"), "template_id": template_id(F.col("template_str"))}
    return rows.select(*[c.alias(k) for k, c in cols.items()])


def under_cap(events: DataFrame, max_text_bytes: int) -> DataFrame:
    """Canonical events with component and params under the cap; what is under it already stays."""
    done = F.col("text_cap").eqNullSafe(F.lit(max_text_bytes)) if "text_cap" in events.columns else F.lit(False)
    capped = lambda c: F.when(done, c).otherwise(cap_text(c, max_text_bytes))
    return events.withColumns({"component": capped(F.col("component")), "params": F.transform("params", capped), "text_cap": F.lit(max_text_bytes).cast("int")})


def driver_events(spark: SparkSession, sf_dir: str, window: str = "day", template: str = "coarse", component: str = "user", slow_half: bool = False) -> DataFrame:
    """The events table as canonical events. window: day, w10 or w15 (ten or fifteen days). template: coarse (type and k
    modulo 10), fine (type and k), type, or kmod (k modulo 10 alone). component: user (one in eight unlocated) or svc."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    span = {"day": 1, "w10": 10, "w15": 15}[window]
    names: dict[str, Column] = {
        "coarse": F.concat(F.col("event_type"), F.lit(" k="), (k % 10).cast("string")), "fine": F.concat(F.col("event_type"), F.lit(" k="), k.cast("string")),
        "type": F.col("event_type"), "kmod": F.concat(F.lit("k="), (k % 10).cast("string")),
    }
    levels = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    user = F.col("user_id")
    where = F.concat(F.lit("svc_"), (user % 8).cast("string")) if component == "svc" else F.when(user % 8 != 7, F.concat(F.lit("u"), user.cast("string")))
    ns = (F.col("value") * 1e6).cast("long") * (F.when(F.expr("datediff(ts, '2024-01-01') div 15") == 1, 16).otherwise(1) if slow_half else 1)
    rows = e.select(
        (F.floor(day / span)).cast("long").alias("window_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), names[template].alias("template_str"),
        levels.alias("level"), F.when(F.col("event_type") == "purchase", TERMINATOR).otherwise(NONE).alias("role"), where.alias("component"), F.array(user.cast("string"), k.cast("string")).alias("params"),
        F.array(F.struct(F.lit("latency_ms").alias("field_name"), F.lit("dur-log2-ns-v1").alias("schedule"), ns.alias("value"))).alias("ordinals"), user.alias("trace_id"))
    return canonical(rows)


def driver_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(spans, children): orders as spans of their customer's nation, lineitems as pending children of their supplier's
    nation, by year."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    customer = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    source = F.lit("orders").alias("source")
    spans = read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(source, F.year("o_orderdate").cast("long").alias("window_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("span_id"), F.concat(F.lit("order "), "o_orderstatus").alias("template_str"), F.col("n_name").alias("component"))
    kids = read("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(source, F.year("l_shipdate").cast("long").alias("window_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("parent_span_id"), F.concat(F.lit("line "), "l_returnflag").alias("template_str"), F.col("n_name").alias("component"))
    return spans.withColumn("template_id", template_id(F.col("template_str"))), kids.withColumn("template_id", template_id(F.col("template_str")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of text files, LF-framed, a closing CR dropped: (path, line)."""
    return spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of JSON lines {component, level, message, role?}; the order is the line's place in the file, of
    several files that of their paths, however they are split."""
    rows = spark.read.schema("component string, level string, message string, role string").json(path)
    split = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = materialise(rows.select("*", *split, F.monotonically_increasing_id().alias("_i")), "lines")
    # lines of a split are numbered in order without gaps; splits are few
    splits = rows.groupBy("_path", "_start").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_start", "_first", before.alias("_before"))
    placed = rows.join(splits, ["_path", "_start"]).withColumn("seq", F.col("_before") + F.col("_i") - F.col("_first"))
    return canonical(placed.select("seq", F.col("message").alias("template_str"), level_of(F.col("level")).alias("level"), role_of(F.col("role")).alias("role"), "component"))


def registry(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(template_id, template_str): the first spelling of each id stays; ``known`` entries come first."""
    new = events.groupBy("template_id").agg(F.min_by("template_str", F.struct("window_id", "seq")).alias("template_str"))
    return new if known is None else merge_registries(known, new)


def merge_registries(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second.join(first, "template_id", "left_anti"))


def lookup(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the template text of each id; empty where it is unknown."""
    names = known.select("template_id", F.col("template_str").alias("_t"))
    return rows.drop("template_str").join(names, "template_id", "left").withColumn("template_str", F.coalesce("_t", F.lit(""))).drop("_t")


def admit(events: DataFrame, known: DataFrame, budget: int | None = None, predicate: Column | None = None) -> DataFrame:
    """Events of known templates and of admitted new ones. A new template is asked for once: it must meet ``predicate``
    and, with a ``budget``, be among the first so many new ones of the stream."""
    new = events.join(known.select("template_id"), "template_id", "left_anti")
    if predicate is not None:
        new = new.where(predicate)
    first = new.groupBy("template_id").agg(F.min(F.struct("window_id", "seq")).alias("at"))
    if budget is not None:
        first = first.orderBy("at").limit(budget)  # each task keeps its first ones, then the first of these
    return events.join(known.select("template_id").unionByName(first.select("template_id")), "template_id", "left_semi")


def discard(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events without those of discarded windows."""
    return events.join(windows, KEYS, "left_anti")
