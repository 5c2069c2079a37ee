"""Registered queries of deltas, composed blocks, wire members, tokens and windows over event time, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import KEYS, Config
from ..functions import hll, text
from ..operators import behavior, cube, histograms, stats, topology
from ..sources import events as src
from ..streaming import live
from . import compose, diff
from .documents import fingerprint, to_json
from .oracle import H, TID, _kl, counts, edges, ev, halves, r6 as sql6, top_grams
from .oracle import CELL, SERVICE, SPANS, cube as cube_sql
from .queries import _documents, _joint, _resolved, r6

PLAIN = Config(trace_scoping_enabled=False)


# deltas


def branching_delta(spark, d):
    x = diff.branching_delta(*_documents(spark, d, PLAIN, {"behavior"}))
    return x.select("template_id", r6("previous_entropy_bits").alias("previous_entropy_bits"), r6("current_entropy_bits").alias("current_entropy_bits"), r6("delta_bits").alias("delta_bits"))


def diff_tail(spark, d):
    x = diff.tail_delta(*_documents(spark, d, Config(top_k_size=16), set()))
    return x.select("tail_unique_delta", r6("tail_entropy_bits_delta").alias("tail_entropy_bits_delta"), r6("tail_max_rate_delta").alias("tail_max_rate_delta"))


def diff_fields(spark, d):
    x = diff.field_histogram_deltas(*_documents(spark, d, Config(top_k_size=16, max_param_histograms=2), {"histograms"}))
    return x.select("template_id", F.col("param_index").cast("long").alias("param_index"), r6("js_divergence").alias("js_divergence"), "previous_total", "current_total", r6("previous_entropy_bits").alias("previous_entropy_bits"), r6("current_entropy_bits").alias("current_entropy_bits"))


def diff_ordinals(spark, d):
    x = diff.ordinal_histogram_deltas(*_documents(spark, d, Config(top_k_size=16, max_param_histograms=1), {"histograms"}))
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return x.select("template_id", "field_name", F.col("previous_schedule").alias("schedule"), "previous_total", "current_total", joined("previous_counts"), joined("current_counts"))


def _year(edges_, year: int):
    return edges_.where(F.col("window_id") == year).withColumn("window_id", F.lit(0).cast("long"))


def service_edge_delta(spark, d):
    e = topology.service_edges(_resolved(spark, d)[0], None, 40)[0]
    return diff.edge_delta(_year(e, 1996), _year(e, 1997), ["caller", "callee"], True).select("caller", "callee", "state", "previous_count", "current_count")


def span_edge_delta(spark, d):
    e = topology.span_edges(_resolved(spark, d)[0], 4, 4096)[0]
    return diff.edge_delta(_year(e, 1996), _year(e, 1997), ["parent_template", "child_template"], False).select("parent_template", "child_template", "state")


def diff_members(spark, d):
    """Members of the diff on the wire."""
    j = diff.to_json(diff.diff(*_documents(spark, d, Config(top_k_size=16, reservoir_size=16, max_param_histograms=2))))
    at = lambda p, t="long": F.get_json_object("json", p).cast(t)
    return j.select(
        at("$.comparison_outcome", "string").alias("comparison_outcome"), at("$.max_text_bytes").alias("max_text_bytes"), r6(at("$.js_divergence", "double")).alias("js_divergence"), F.coalesce(at("$.template_deltas[0].delta"), F.lit(0).cast("long")).alias("largest_delta"),
        F.coalesce(F.json_array_length(F.get_json_object("json", "$.new_templates")), F.lit(0)).cast("long").alias("new_templates"), F.coalesce(F.json_array_length(F.get_json_object("json", "$.vanished_templates")), F.lit(0)).cast("long").alias("vanished_templates"))


# composed blocks


def compose_histograms(spark, d):
    c = compose.compose(*_documents(spark, d, Config(top_k_size=16, max_param_histograms=2, max_histogram_values=8), {"histograms"}))
    v = c.values.where("admitted").groupBy(*histograms.SLOT).agg(F.count("*").alias("kept_values"), F.sum("count").alias("kept_count"))
    return v.join(c.slots.select(*histograms.SLOT, "total"), histograms.SLOT).select("template_id", F.col("param_index").cast("long").alias("param_index"), "total", "kept_values", "kept_count")


def compose_fold_top(spark, d):
    """Three ten-day documents folded in order: their top lists."""
    docs = fingerprint(src.driver_events(spark, d, window="w10"), Config(top_k_size=16), blocks=set())
    c = compose.fold(docs, [0, 1, 2])
    return c.rows.select(F.col("place").cast("long").alias("rank"), "template_id", "count")


def compose_provenance(spark, d):
    """Windows that a fold of three documents came from, in order."""
    docs = fingerprint(src.driver_events(spark, d, window="w10"), Config(top_k_size=4, source_ref="events"), blocks=set())
    c = compose.fold(docs, [0, 1, 2])
    p = c.header.select(F.posexplode("provenance").alias("place", "p"), F.size("coordinate").cast("long").alias("leaves"))
    return p.select(F.col("place").cast("long").alias("place"), text.format_rfc3339(F.col("p.start")).alias("start"), text.format_rfc3339(F.col("p.end")).alias("end"), F.col("p.lines").alias("lines"), "leaves")


# wire members


def document_members(spark, d):
    """Members of the documents on the wire."""
    j = to_json(fingerprint(src.driver_events(spark, d, window="w10", component="svc"), Config(top_k_size=16, trace_scoping_enabled=False)))
    at = lambda p, t="long": F.get_json_object("json", p).cast(t)
    return j.select(
        "window_id", at("$.window.lines_observed").alias("lines_observed"), at("$.window.duration_seconds").alias("duration_seconds"), at("$.stats.unique_templates").alias("unique_templates"), at("$.stats.top_k[0].template_id", "string").alias("first_template"),
        at("$.stats.top_k[0].count").alias("first_count"), at("$.stats.top_k[0].level", "string").alias("first_level"), at("$.behavior.graph_edge_count").alias("graph_edge_count"), at("$.stability.new_templates").alias("new_templates"), at("$.stability.previous_window_end", "string").alias("previous_window_end"),
        at("$.cube.cell_count").alias("cell_count"), at("$.cube.raw_cell_count").alias("raw_cell_count"), at("$.cube.cell_budget").alias("cell_budget"), at("$.extensions.acquisition.records_with_component").alias("records_with_component"),
        at("$.extensions.acquisition.where_cardinality_per_depth[0]").alias("components"), at("$.extensions.acquisition.level_cardinality").alias("level_cardinality"), at("$.max_text_bytes").alias("max_text_bytes"))


def document_cells(spark, d):
    """The cube's cells in the order in which documents list them."""
    j = to_json(fingerprint(src.driver_events(spark, d, window="w15", component="svc"), Config(top_k_size=4), blocks={"cube"}))
    cells = F.from_json(F.get_json_object("json", "$.cube.cells"), "array<struct<coord:struct<level:string,where:array<string>,structural_role:string>,count:long>>")
    return j.select("window_id", F.posexplode(cells).alias("place", "c")).select("window_id", F.col("place").cast("long").alias("place"), "c.coord.level", F.get("c.coord.where", F.lit(0)).alias("component"), F.col("c.coord.structural_role").alias("role"), F.col("c.count").alias("count"))


# cube


def cube_recovered(spark, d):
    """The joint found back from closed cells alone."""
    return cube.recover_base(cube.closed(_joint(spark, d))).select("window_id", F.col("level").cast("long").alias("level"), "component", F.col("role").cast("long").alias("role"), "count")


def cube_states(spark, d):
    """Each window's coarsening under a budget of 100 cells, and the note on it."""
    s = cube.collapse_note(cube.collapse_states(_joint(spark, d), 100))
    return s.select("window_id", F.col("band_floor").cast("long").alias("band_floor"), F.col("floor_depth").cast("long").alias("floor_depth"), "note")


def where_conflicts(spark, d):
    """Nations named as parents of order statuses: which statuses have several."""
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    return cube.tree_conflicts(o.select(F.array(F.col("c_nationkey").cast("string"), "o_orderpriority").alias("path"))).select(F.col("depth").cast("long").alias("depth"), "value", "parents")


# sketches


def hll_registers(spark, d):
    v = histograms.param_values(src.driver_events(spark, d, window="w10", template="type"), 1)
    r = hll.registers(v, ["window_id", "template_id"], "value")
    return r.groupBy("window_id", "template_id").agg(F.count("*").alias("registers"), F.sum("rank").cast("long").alias("ranks"), F.sum("idx").cast("long").alias("places"))


# spans


def linked_services(spark, d):
    """Line items that link to their orders' spans."""
    resolved = _resolved(spark, d)[0]
    return topology.service_edges(resolved.limit(0), resolved, 1 << 30)[0].select("window_id", "caller", "callee", "count")


def span_edges_refused(spark, d):
    return topology.span_edges(_resolved(spark, d)[0], 32, 3)[1].select("window_id", "dropped_span_edge_observations")


def ngrams_without_spans(spark, d):
    e = src.driver_events(spark, d, window="w10").withColumn("is_span", F.col("template_str").startswith("click"))
    table, _ = behavior.ngrams(e, PLAIN)
    return behavior.top_ngrams(table, 32).select("window_id", F.col("rank").cast("long"), F.array_join("ids", ">").alias("sequence"), "count")


# tokens and times


def level_tokens(spark, d):
    e = src.driver_events(spark, d)
    level, role = F.col("level"), F.col("role")
    odd = F.when(F.col("seq") % 5 == 0, 6).otherwise(level).cast("int")
    rows = e.select(odd.alias("level"), "role").distinct()
    return rows.select(level.cast("long").alias("level"), text.level_token(level).alias("token"), text.row_level_token(level).alias("row_token"), text.level_of(text.level_token(level)).cast("long").alias("back"), text.role_name(role).alias("role_name"), text.role_of(text.role_name(role)).cast("long").alias("role_back"))


def run_outcomes(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", "Success").when(F.col("o_orderstatus") == "P", "Cancelled").when(F.col("o_orderkey") % 2 == 0, "unstable").otherwise("Unknown")
    return spark.read.parquet(f"{d}/orders.parquet").select(said.alias("said")).groupBy("said").count().select("said", text.outcome_token(F.col("said")).alias("token"), F.col("count").alias("runs"))


def event_times(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shown = text.format_rfc3339(F.col("ts"))
    first = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return e.select("event_id", shown.alias("shown"), F.unix_seconds(text.parse_rfc3339(shown)).alias("back"), text.duration_seconds(first, F.col("ts")).alias("duration_seconds"), text.duration_seconds(F.col("ts"), first).alias("backwards"), text.ticks(F.col("ts")).alias("ticks"))


def display_forms(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").select("text").distinct().where("text is not null and length(text) = octet_length(text) and text not like '%~%'")
    return t.select(text.template_id(F.col("text")).alias("text_id"), text.display_form(text.cap_text(F.col("text"), 64), 64).alias("shown"))


def registry_merge(spark, d):
    e = src.driver_events(spark, d, template="fine")
    known = e.where("window_id = 0").select("template_id", F.lit("known").alias("template_str")).distinct()
    both = src.merge_registries(known, src.registry(e))
    seen = src.lookup(e.select("template_id").distinct(), both)
    return seen.select("template_id", "template_str")


# windows over event time


def _timed(spark, d):
    return src.driver_events(spark, d, template="type")


def tumbling_counts(spark, d):
    c = live.windowed_counts(_timed(spark, d), "6 hours", "0 seconds")
    return c.select(F.unix_seconds("start").alias("start"), "template_id", "count")


def sliding_counts(spark, d):
    c = live.windowed_counts(_timed(spark, d), "2 days", "0 seconds", "1 day")
    return c.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "template_id", "count")


def session_counts(spark, d):
    s = live.sessions(_timed(spark, d), "12 hours", "0 seconds")
    return s.select("trace_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "count")


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in ("queries", "oracle_sql") and getattr(f, "__module__", "") == __name__}


LEVEL = "CASE {0} WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' WHEN 6 THEN 'UNKNOWN' END"
ROLE = "CASE {0} WHEN 0 THEN 'None' WHEN 1 THEN 'GroupBegin' WHEN 2 THEN 'GroupEnd' WHEN 3 THEN 'Terminator' WHEN 4 THEN 'Progress' END"


def _branches(window: str) -> str:
    return edges(window=window, component="svc") + f""",
bb AS (SELECT win, a, count(*) AS fanout, max(outgoing) AS total, {H('n', 'outgoing')} AS h FROM e GROUP BY win, a),
br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY round(h, 12) DESC, total DESC, a) AS rk FROM bb) WHERE rk <= 64)"""


def _sides(columns: str, source: str) -> str:
    return f"(SELECT {columns} FROM {source} WHERE win = 0) p, (SELECT {columns} FROM {source} WHERE win = 1) c"


def oracle_sql() -> dict[str, str]:
    out = {}
    out["branching_delta"] = _branches("w15") + f" SELECT p.a AS template_id, {sql6('p.h')} AS previous_entropy_bits, {sql6('c.h')} AS current_entropy_bits, {sql6('c.h - p.h')} AS delta_bits FROM (SELECT * FROM br WHERE win = 0) p JOIN (SELECT * FROM br WHERE win = 1) c ON p.a = c.a"
    tails = halves() + ", t AS (SELECT *, sum(n) OVER (PARTITION BY win) AS tm FROM cnt WHERE rk > 16), s AS (SELECT win, count(*) AS u, " + H("n", "tm") + " AS e, max(n) / max(lines) AS mx FROM t GROUP BY win)"
    out["diff_tail"] = tails + f" SELECT c.u - p.u AS tail_unique_delta, {sql6('c.e - p.e')} AS tail_entropy_bits_delta, {sql6('c.mx - p.mx')} AS tail_max_rate_delta FROM {_sides('*', 's')}"
    values = ", v0 AS (SELECT win, tid, seq, 0 AS i, CAST(usr AS VARCHAR) AS v FROM ev UNION ALL SELECT win, tid, seq, 1, CAST(k AS VARCHAR) FROM ev), v1 AS (SELECT win, tid, i, v, count(*) AS n, min(seq) AS first FROM v0 GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY win, tid, i ORDER BY first) AS seen, sum(n) OVER (PARTITION BY win, tid, i) AS total FROM v1 WHERE EXISTS (SELECT 1 FROM top WHERE top.win = v1.win AND top.tid = v1.tid))"
    out["diff_fields"] = halves() + values + ", h AS (SELECT * FROM v WHERE seen <= 64), p AS (SELECT * FROM h WHERE win = 0), c AS (SELECT * FROM h WHERE win = 1), tt AS (SELECT tid, i, CAST(max(total) FILTER (win = 0) AS BIGINT) AS na, CAST(max(total) FILTER (win = 1) AS BIGINT) AS nb, sum(n * (log2(total) - log2(n)) / total) FILTER (win = 0) AS ha, sum(n * (log2(total) - log2(n)) / total) FILTER (win = 1) AS hb FROM h WHERE win IN (0, 1) GROUP BY tid, i), u AS (SELECT DISTINCT tid, i, v FROM h WHERE win IN (0, 1)), d AS (SELECT u.tid, u.i, p.n AS a, c.n AS b, na, nb, ha, hb, count(*) OVER (PARTITION BY u.tid, u.i) AS k FROM u JOIN tt ON tt.tid = u.tid AND tt.i = u.i LEFT JOIN p ON p.tid = u.tid AND p.i = u.i AND p.v = u.v LEFT JOIN c ON c.tid = u.tid AND c.i = u.i AND c.v = u.v), x AS (SELECT tid, i, any_value(na) AS na, any_value(nb) AS nb, any_value(ha) AS ha, any_value(hb) AS hb, " + _kl() + f" FROM d WHERE na > 0 AND nb > 0 GROUP BY tid, i) SELECT tid AS template_id, CAST(i AS BIGINT) AS param_index, {sql6('js')} AS js_divergence, na AS previous_total, nb AS current_total, {sql6('ha')} AS previous_entropy_bits, {sql6('hb')} AS current_entropy_bits FROM x"
    slow = counts(window="w15", component="svc", slow=True) + ", top AS (SELECT * FROM cnt WHERE rk <= 16)"
    moved = out["diff_fields"].rsplit(" SELECT tid AS template_id", 1)[0]
    out["diff_outcome"] = moved + " SELECT CASE WHEN (SELECT count(*) FROM dd WHERE a IS DISTINCT FROM b) > 0 THEN 'changed' ELSE 'unchanged' END AS comparison_outcome, CASE WHEN (SELECT count(*) FROM x WHERE js > 0 OR ha <> hb) > 0 THEN 'field_histogram_deltas' ELSE '' END AS withheld_signals"
    out["diff_ordinals"] = slow + """, b AS (SELECT win, tid, CASE WHEN ns < 2 THEN 0 ELSE least(47, length(bin(ns)) - 1) END AS bin FROM ev WHERE EXISTS (SELECT 1 FROM top WHERE top.win = ev.win AND top.tid = ev.tid)),
g AS (SELECT unnest(range(48)) AS bin), w AS (SELECT DISTINCT win, tid FROM b), f AS (SELECT w.win, w.tid, g.bin, (SELECT count(*) FROM b WHERE b.win = w.win AND b.tid = w.tid AND b.bin = g.bin) AS n FROM w, g),
s AS (SELECT win, tid, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bin) AS c, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY win, tid)
SELECT p.tid AS template_id, 'latency_ms' AS field_name, 'dur-log2-ns-v1' AS schedule, p.n AS previous_total, c.n AS current_total, p.c AS previous_counts, c.c AS current_counts FROM (SELECT * FROM s WHERE win = 0) p JOIN (SELECT * FROM s WHERE win = 1) c ON p.tid = c.tid"""
    state = "CASE WHEN p.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'vanished' ELSE 'changed' END AS state"
    out["service_edge_delta"] = SERVICE + f" SELECT coalesce(p.caller, c.caller) AS caller, coalesce(p.callee, c.callee) AS callee, {state}, p.n AS previous_count, c.n AS current_count FROM (SELECT * FROM r WHERE rk <= 40 AND win = 1996) p FULL JOIN (SELECT * FROM r WHERE rk <= 40 AND win = 1997) c ON p.caller = c.caller AND p.callee = c.callee WHERE p.n IS DISTINCT FROM c.n"
    spans = SPANS + f", e AS (SELECT win, {TID.format('parent')} AS p, {TID.format('child')} AS c, count(*) AS n FROM res WHERE found GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, p, c) AS rk FROM e)"
    out["span_edge_delta"] = spans + f" SELECT coalesce(p.p, c.p) AS parent_template, coalesce(p.c, c.c) AS child_template, {state} FROM (SELECT * FROM r WHERE rk <= 4 AND win = 1996) p FULL JOIN (SELECT * FROM r WHERE rk <= 4 AND win = 1997) c ON p.p = c.p AND p.c = c.c WHERE p.n IS NULL OR c.n IS NULL"
    out["diff_members"] = halves() + ", d AS (SELECT *, count(*) OVER () AS k FROM dd, tl), x AS (SELECT " + _kl() + f""" FROM d)
SELECT CASE WHEN (SELECT count(*) FROM dd WHERE a IS DISTINCT FROM b) > 0 THEN 'changed' ELSE 'unchanged' END AS comparison_outcome, CAST(64 AS BIGINT) AS max_text_bytes, {sql6('js')} AS js_divergence,
    coalesce((SELECT b - a FROM dd WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY abs(b - a) DESC, tid LIMIT 1), 0) AS largest_delta, (SELECT count(*) FROM dd WHERE a IS NULL) AS new_templates, (SELECT count(*) FROM dd WHERE b IS NULL) AS vanished_templates FROM x"""
    out["compose_histograms"] = halves() + values.replace("FROM v1 WHERE", "FROM v1 WHERE win IN (0, 1) AND") + """,
m0 AS (SELECT tid, sum(n) AS n FROM top WHERE win IN (0, 1) GROUP BY tid), m AS (SELECT tid FROM (SELECT *, row_number() OVER (ORDER BY n DESC, tid) AS r FROM m0) WHERE r <= 16),
s AS (SELECT tid, i, v, sum(n) AS n FROM v WHERE seen <= 8 GROUP BY tid, i, v), r AS (SELECT *, row_number() OVER (PARTITION BY tid, i ORDER BY n DESC, v) AS rk FROM s),
t AS (SELECT tid, i, CAST(sum(total) AS BIGINT) AS total FROM (SELECT DISTINCT win, tid, i, total FROM v) GROUP BY tid, i)
SELECT r.tid AS template_id, CAST(r.i AS BIGINT) AS param_index, any_value(t.total) AS total, count(*) AS kept_values, CAST(sum(n) AS BIGINT) AS kept_count FROM r JOIN t ON t.tid = r.tid AND t.i = r.i WHERE rk <= 8 AND r.tid IN (SELECT tid FROM m) GROUP BY r.tid, r.i"""
    out["compose_fold_top"] = counts(window="w10") + """, top AS (SELECT * FROM cnt WHERE rk <= 16), a0 AS (SELECT tid, sum(n) AS n FROM top WHERE win IN (0, 1) GROUP BY tid), a AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, tid) AS r FROM a0) WHERE r <= 16),
b0 AS (SELECT tid, sum(n) AS n FROM (SELECT tid, n FROM a UNION ALL SELECT tid, n FROM top WHERE win = 2) GROUP BY tid) SELECT * FROM (SELECT row_number() OVER (ORDER BY n DESC, tid) AS rank, tid AS template_id, CAST(n AS BIGINT) AS count FROM b0) WHERE rank <= 16"""
    shown = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
    out["compose_provenance"] = f"""WITH e AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS win, ts FROM events), w AS (SELECT win, min(ts) AS a, max(ts) AS b, count(*) AS n FROM e WHERE win <= 2 GROUP BY win),
p AS (SELECT a, b, n FROM w UNION ALL SELECT min(a), max(b), CAST(sum(n) AS BIGINT) FROM w WHERE win <= 1)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS place, {shown.format('a')} AS "start", {shown.format('b')} AS "end", n AS lines, CAST(3 AS BIGINT) AS leaves FROM p"""
    out["document_members"] = edges(component="svc") + ",\npos AS" + counts(window="w10", component="svc").split("),\npos AS", 1)[1] + ",\n" + cube_sql() + f""",
f AS (SELECT *, row_number() OVER (PARTITION BY cnt.win ORDER BY n DESC, tid) AS r FROM cnt), t0 AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS win, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
lv AS (SELECT win, tid, level, row_number() OVER (PARTITION BY win, tid ORDER BY count(*) DESC, level DESC) AS r FROM ev GROUP BY win, tid, level),
cc AS (SELECT win, count(*) FILTER (closed) AS closed, count(*) AS raw FROM cell GROUP BY win), ac AS (SELECT win, count(comp) AS located, count(DISTINCT comp) AS comps, count(DISTINCT level) AS levels FROM ev GROUP BY win)
SELECT f.win AS window_id, f.lines AS lines_observed, CAST(floor(epoch(t0.b)) - floor(epoch(t0.a)) AS BIGINT) AS duration_seconds, (SELECT count(*) FROM cnt c WHERE c.win = f.win) AS unique_templates, f.tid AS first_template, f.n AS first_count, {LEVEL.format('lv.level')} AS first_level,
    (SELECT count(*) FROM e WHERE e.win = f.win) AS graph_edge_count, CASE WHEN EXISTS (SELECT 1 FROM cnt c WHERE c.win = f.win - 1) THEN (SELECT count(*) FROM cnt c WHERE c.win = f.win AND NOT EXISTS (SELECT 1 FROM cnt q WHERE q.win = f.win - 1 AND q.tid = c.tid)) END AS new_templates,
    {shown.format('(SELECT b FROM t0 q WHERE q.win = f.win - 1)')} AS previous_window_end, cc.closed AS cell_count, cc.raw AS raw_cell_count, CAST(4096 AS BIGINT) AS cell_budget, located AS records_with_component, comps AS components, levels AS level_cardinality, CAST(64 AS BIGINT) AS max_text_bytes
FROM f JOIN t0 ON t0.win = f.win JOIN lv ON lv.win = f.win AND lv.tid = f.tid AND lv.r = 1 JOIN cc ON cc.win = f.win JOIN ac ON ac.win = f.win WHERE f.r = 1"""
    out["document_cells"] = ev(window="w15", component="svc") + ",\n" + cube_sql() + f" SELECT win AS window_id, row_number() OVER (PARTITION BY win ORDER BY m, level NULLS LAST, comp NULLS LAST, role NULLS LAST) - 1 AS place, {LEVEL.format('level')} AS level, comp AS component, {ROLE.format('role')} AS role, n AS count FROM cell WHERE closed"
    out["cube_recovered"] = ev() + ",\n" + cube_sql() + f" SELECT {CELL} FROM base"
    options = "opt AS (SELECT * FROM (VALUES (0, 1), (2, 1), (3, 1), (4, 1), (0, 0), (2, 0), (3, 0), (4, 0)) AS t(b, d))"
    small = "j AS (SELECT win, level, comp, role, count(*) AS n FROM ev GROUP BY ALL), " + options + ", base AS (SELECT win * 100 + b * 10 + d AS win, CASE WHEN level < b THEN b - 1 ELSE level END AS level, CASE WHEN d > 0 THEN comp END AS comp, role, CAST(sum(n) AS BIGINT) AS n FROM j, opt GROUP BY ALL)"
    out["cube_states"] = ev().replace("WITH raw", "WITH RECURSIVE raw", 1) + ",\n" + cube_sql(small) + """,
k AS (SELECT win // 100 AS win, win // 10 % 10 AS b, win % 10 AS d, count(*) AS n FROM cell WHERE closed GROUP BY ALL),
walk AS (SELECT DISTINCT win, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS d, 0 AS step FROM k
UNION ALL SELECT win, CASE WHEN w THEN b WHEN g THEN nb ELSE b END, CASE WHEN w THEN d - 1 ELSE d END, step + 1 FROM (
    SELECT *, wok AND (NOT bok OR gw * nb > gb * 100) AS w, bok AS g FROM (SELECT *, now > 100 AND coalesce(gb, 0) > 0 AS bok, now > 100 AND coalesce(gw, 0) > 0 AS wok FROM (
        SELECT s.win, s.b, s.d, s.step, CASE WHEN s.b = 0 THEN 2 ELSE s.b + 1 END AS nb, a.n AS now, CASE WHEN s.b < 4 THEN a.n - x.n END AS gb, CASE WHEN s.d > 0 THEN a.n - y.n END AS gw
        FROM walk s JOIN k a ON a.win = s.win AND a.b = s.b AND a.d = s.d LEFT JOIN k x ON x.win = s.win AND x.b = CASE WHEN s.b = 0 THEN 2 ELSE s.b + 1 END AND x.d = s.d LEFT JOIN k y ON y.win = s.win AND y.b = s.b AND y.d = s.d - 1 WHERE s.step < 4))))
SELECT win AS window_id, b AS band_floor, d AS floor_depth, nullif(concat_ws('; ', CASE WHEN b > 0 THEN 'levels below ' || b || ' folded' END, CASE WHEN d = 0 THEN 'components dropped' END), '') AS note FROM walk WHERE step = 4"""
    out["cube_collapsed"] = out["cube_states"].rsplit("\nSELECT", 1)[0] + " SELECT walk.win AS window_id, walk.b AS band_floor, walk.d AS floor_depth, k.n AS cells FROM walk JOIN k ON k.win = walk.win AND k.b = walk.b AND k.d = walk.d WHERE step = 4"
    dims, bits = ("level", "comp", "role", "shift"), (1, 2, 4, 8)
    star = ", ".join(f"CASE WHEN m & {b} > 0 THEN {d} END AS {d}" for d, b in zip(dims, bits, strict=True))
    there = " AND ".join(f"(m & {b} = 0 OR {d} IS NOT NULL)" for d, b in zip(dims, bits, strict=True))
    same = lambda a, b: f"{a}.m = {b}.m AND " + " AND ".join(f"{a}.{d} IS NOT DISTINCT FROM {b}.{d}" for d in dims)
    under = "x.dir = y.dir AND (" + " OR ".join("(x.m | " + str(b) + " = y.m AND x.m <> y.m AND " + " AND ".join(f"x.{e} IS NOT DISTINCT FROM y.{e}" for e in dims if e != d) + ")" for d, b in zip(dims, bits, strict=True)) + ")"
    out["cube_latency_border"] = ev(window="w15", component="svc", slow=True) + f""",
dom AS (SELECT win, tid, comp FROM (SELECT win, tid, comp, row_number() OVER (PARTITION BY win, tid ORDER BY count(*) DESC, comp) AS r FROM ev GROUP BY win, tid, comp) WHERE r = 1),
bins AS (SELECT ev.win, dom.comp, CASE WHEN ns < 2 THEN 0 ELSE least(47, length(bin(ns)) - 1) END AS bin FROM ev JOIN dom USING (win, tid)),
tt AS (SELECT comp, count(*) FILTER (win = 0) AS na, count(*) FILTER (win = 1) AS nb FROM bins GROUP BY comp),
f AS (SELECT tt.comp, g.bin, na, nb, (SELECT count(*) FROM bins b WHERE b.comp = tt.comp AND b.win = 0 AND b.bin <= g.bin) AS ca, (SELECT count(*) FROM bins b WHERE b.comp = tt.comp AND b.win = 1 AND b.bin <= g.bin) AS cb FROM tt, (SELECT unnest(range(48)) AS bin) g WHERE least(na, nb) >= 32),
w AS (SELECT comp, any_value(na) * any_value(nb) AS q, sum(abs(cb * na - ca * nb)) AS num, sum(cb * na - ca * nb) AS sg FROM f GROUP BY comp),
lab AS (SELECT comp, CASE WHEN sg > 0 THEN 'down_' ELSE 'up_' END || CASE WHEN num >= 5 * q THEN 'high' WHEN num >= 2 * q THEN 'med' ELSE 'low' END AS shift FROM w WHERE 2 * num >= q AND sg <> 0),
base AS (SELECT win, level, ev.comp, role, CASE WHEN win = 1 THEN lab.shift END AS shift, count(*) AS n FROM ev LEFT JOIN lab ON lab.comp = ev.comp WHERE win IN (0, 1) GROUP BY ALL),
cell AS (SELECT win, m, level, comp, role, shift, CAST(sum(n) AS BIGINT) AS n FROM (SELECT win, m, {star}, n FROM base, (SELECT unnest(range(16)) AS m) WHERE {there}) GROUP BY ALL),
new AS (SELECT 'emerging' AS dir, c.* FROM cell c WHERE win = 1 AND NOT EXISTS (SELECT 1 FROM cell p WHERE p.win = 0 AND {same('p', 'c')}) UNION ALL SELECT 'vanishing', c.* FROM cell c WHERE win = 0 AND NOT EXISTS (SELECT 1 FROM cell p WHERE p.win = 1 AND {same('p', 'c')})),
hit AS (SELECT x.dir AS dir, x.m AS xm, x.level AS xl, x.comp AS xc, x.role AS xr, x.shift AS xs, y.m AS ym, y.level AS yl, y.comp AS yc, y.role AS yr, y.shift AS ys FROM new x JOIN new y ON {under})
SELECT dir AS direction, side, CAST(level AS BIGINT) AS level, comp AS component, CAST(role AS BIGINT) AS role, shift AS latency_shift, n AS count FROM (
    SELECT 'upper' AS side, * FROM new n WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.dir = n.dir AND h.ym = n.m AND h.yl IS NOT DISTINCT FROM n.level AND h.yc IS NOT DISTINCT FROM n.comp AND h.yr IS NOT DISTINCT FROM n.role AND h.ys IS NOT DISTINCT FROM n.shift)
    UNION ALL SELECT 'lower' AS side, * FROM new n WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.dir = n.dir AND h.xm = n.m AND h.xl IS NOT DISTINCT FROM n.level AND h.xc IS NOT DISTINCT FROM n.comp AND h.xr IS NOT DISTINCT FROM n.role AND h.xs IS NOT DISTINCT FROM n.shift))"""
    out["where_conflicts"] = "SELECT CAST(2 AS BIGINT) AS depth, o_orderpriority AS value, count(DISTINCT c_nationkey) AS parents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority HAVING count(DISTINCT c_nationkey) > 1"
    two64 = "18446744073709551616::UHUGEINT"
    mix = lambda h: f"xor({h}, {h} // 8589934592::UHUGEINT)"
    hashed = ev(window="w10", template="type") + f""", v AS (SELECT DISTINCT win, tid, CAST(usr AS VARCHAR) AS v FROM ev),
h0 AS (SELECT win, tid, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(v) + 1), lambda i: CAST(ord(substr(v, CAST(i AS INTEGER), 1)) AS UHUGEINT))), lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % {two64}) AS h FROM v),
h1 AS (SELECT win, tid, ({mix('h')} * 18397679294719823053::UHUGEINT) % {two64} AS h FROM h0), h2 AS (SELECT win, tid, ({mix('h')} * 14181476777654086739::UHUGEINT) % {two64} AS h FROM h1), h3 AS (SELECT win, tid, {mix('h')} AS h FROM h2),
g AS (SELECT win, tid, CAST(h // 1125899906842624::UHUGEINT AS BIGINT) AS idx, CAST((h * 16384::UHUGEINT) % {two64} AS UBIGINT) AS rest FROM h3),
regs AS (SELECT win, tid, idx, max(CASE WHEN rest = 0 THEN 51 ELSE 65 - length(bin(rest)) END) AS rank FROM g GROUP BY win, tid, idx)"""
    out["hll_registers"] = hashed + " SELECT win AS window_id, tid AS template_id, count(*) AS registers, CAST(sum(rank) AS BIGINT) AS ranks, CAST(sum(idx) AS BIGINT) AS places FROM regs GROUP BY win, tid"
    raw = "(0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + (16384 - n)))"
    out["hll_cardinality"] = hashed + f", z AS (SELECT win, tid, count(*) AS n, sum(pow(2.0, -rank)) AS s FROM regs GROUP BY win, tid) SELECT win AS window_id, tid AS template_id, CAST(floor(CASE WHEN {raw} < 2.5 * 16384 AND n < 16384 THEN 16384.0 * ln(16384.0 / (16384 - n)) ELSE {raw} END) AS BIGINT) AS estimate FROM z"
    out["linked_services"] = SPANS + " SELECT win AS window_id, callee AS caller, caller AS callee, count(*) AS count FROM res WHERE found AND caller <> callee GROUP BY ALL"
    out["span_edges_refused"] = SPANS + f", e AS (SELECT win, {TID.format('parent')} AS p, {TID.format('child')} AS c, count(*) AS n, min(seq) AS first FROM res WHERE found GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY first, p, c) AS seen FROM e) SELECT win AS window_id, CAST(coalesce(sum(n) FILTER (seen > 3), 0) AS BIGINT) AS dropped_span_edge_observations FROM r GROUP BY win"
    out["ngrams_without_spans"] = "SELECT window_id, rank, sequence, count FROM (" + top_grams(2, window="w10").replace("FROM ev)", "FROM ev WHERE tmpl NOT LIKE 'click%')", 1) + ")"
    back = "CAST({0} AS BIGINT)"
    out["level_tokens"] = ev() + f" SELECT DISTINCT CAST(level AS BIGINT) AS level, {LEVEL.format('level')} AS token, CASE WHEN level < 6 THEN {LEVEL.format('level')} END AS row_token, {back.format('level')} AS back, {ROLE.format('role')} AS role_name, {back.format('role')} AS role_back FROM (SELECT CASE WHEN seq % 5 = 0 THEN 6 ELSE level END AS level, role FROM ev)"
    out["run_outcomes"] = "WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'P' THEN 'Cancelled' WHEN o_orderkey % 2 = 0 THEN 'unstable' ELSE 'Unknown' END AS said FROM orders) SELECT said, CASE said WHEN 'Success' THEN 'success' WHEN 'Cancelled' THEN 'aborted' WHEN 'unstable' THEN 'unstable' END AS token, count(*) AS runs FROM s GROUP BY said"
    out["event_times"] = f"SELECT event_id, {shown.format('ts')} AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS back, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS duration_seconds, CAST(0 AS BIGINT) AS backwards, epoch_us(ts) * 1000 AS ticks FROM events"
    out["display_forms"] = f"SELECT {TID.format('text')} AS text_id, CASE WHEN strlen(text) < 64 THEN text ELSE left(text, 47) || '…' END AS shown FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND length(text) = strlen(text) AND text NOT LIKE '%~%')"
    out["registry_merge"] = ev(template="fine") + " SELECT tid AS template_id, CASE WHEN min(win) = 0 THEN 'known' ELSE any_value(tmpl) END AS template_str FROM ev GROUP BY tid"
    timed = f"WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) AS us, user_id AS usr, {TID.format('event_type')} AS tid FROM events)"
    out["tumbling_counts"] = timed + ' SELECT s // 21600 * 21600 AS "start", tid AS template_id, count(*) AS count FROM e GROUP BY ALL'
    out["sliding_counts"] = timed + ', w AS (SELECT unnest([s // 86400 * 86400, s // 86400 * 86400 - 86400]) AS a, tid FROM e) SELECT a AS "start", a + 172800 AS "end", tid AS template_id, count(*) AS count FROM w GROUP BY ALL'
    out["session_counts"] = timed + """, l AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY usr ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY usr ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT usr AS trace_id, CAST(floor(min(us) / 1000000) AS BIGINT) AS "start", CAST(floor((max(us) + 43200000000) / 1000000) AS BIGINT) AS "end", count(*) AS count FROM g GROUP BY usr, k"""
    return out
