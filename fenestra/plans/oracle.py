"""The registered queries' results as SQL for DuckDB, independent of the operators."""

from __future__ import annotations

SPAN = {"day": 1, "w10": 10, "w15": 15}
TEMPLATE = {"coarse": "event_type || ' k=' || (k % 10)", "fine": "event_type || ' k=' || k", "type": "event_type", "kmod": "'k=' || (k % 10)"}
TID = "'h:' || substr(sha256({0}), 1, 32)"


def ev(window: str = "day", template: str = "coarse", component: str = "user", slow: bool = False) -> str:
    """CTEs raw and ev: seq, win, tmpl, tid, level, role, comp, user, k, ns."""
    comp = "'svc_' || (user_id % 8)" if component == "svc" else "CASE WHEN user_id % 8 <> 7 THEN 'u' || user_id END"
    times = "CASE WHEN day // 15 = 1 THEN 16 ELSE 1 END" if slow else "1"
    return f"""WITH raw AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
ev AS (SELECT event_id AS seq, CAST(day // {SPAN[window]} AS BIGINT) AS win, {TEMPLATE[template]} AS tmpl, {TID.format(TEMPLATE[template])} AS tid,
    CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS level,
    CASE WHEN event_type = 'purchase' THEN 3 ELSE 0 END AS role, {comp} AS comp, user_id AS usr, k,
    CAST(trunc(value * 1e6) AS BIGINT) * {times} AS ns FROM raw)"""


def counts(**kw) -> str:
    """ev, and cnt: per window and template n, first (0-based place of first sight), rk, iid, lines."""
    return (
        ev(**kw)
        + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY seq) - 1 AS place FROM ev),
c0 AS (SELECT win, tid, any_value(tmpl) AS tmpl, count(*) AS n, min(place) AS first FROM pos GROUP BY win, tid),
cnt AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, tid) AS rk, row_number() OVER (PARTITION BY win ORDER BY first) - 1 AS iid,
    CAST(sum(n) OVER (PARTITION BY win) AS BIGINT) AS lines FROM c0)"""
    )


def H(c: str, total: str) -> str:
    return f"sum({c} * (log2({total}) - log2({c})) / {total})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def grams(n: int, ring: str = "0", **kw) -> str:
    """ev, and g: one row per n-gram occurrence with its key, prefix and place."""
    lags = [f"lag(tid, {i}) OVER (PARTITION BY win, {ring} ORDER BY seq)" for i in range(n - 1, 0, -1)]
    names = ", ".join(f"{x} AS p{i}" for i, x in enumerate(lags))
    key = " || '>' || ".join([*[f"p{i}" for i in range(n - 1)], "tid"])
    prefix = " || '>' || ".join(f"p{i}" for i in range(n - 1))
    return (
        ev(**kw)
        + f""",
l AS (SELECT win, seq, usr, tid, {names} FROM ev),
g0 AS (SELECT win, seq, {key} AS sequence, {prefix} AS prefix, p0 AS a, {"tid" if n == 2 else "p1"} AS b FROM l WHERE p0 IS NOT NULL),
k0 AS (SELECT win, sequence, any_value(prefix) AS prefix, any_value(a) AS a, any_value(b) AS b, count(*) AS n, min(seq) AS first FROM g0 GROUP BY win, sequence),
k1 AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY first) AS seen FROM k0)"""
    )


def top_grams(n: int, cap: int = 4096, ring: str = "0", **kw) -> str:
    return (
        grams(n, ring, **kw)
        + f""",
t AS (SELECT *, n / sum(n) OVER (PARTITION BY win, prefix) AS p, row_number() OVER (PARTITION BY win ORDER BY n DESC, sequence) AS rk FROM k1 WHERE seen <= {cap})
SELECT win AS window_id, rk AS rank, sequence, n AS count, {r6("p")} AS probability FROM t WHERE rk <= 32"""
    )


def edges(n: int = 2, cap: int = 4096, ring: str = "0", **kw) -> str:
    kw = {"window": "w10"} | kw
    return (
        grams(n, ring, **kw)
        + f""",
e0 AS (SELECT win, a, b, CAST(sum(n) AS BIGINT) AS n FROM k1 WHERE seen <= {cap} GROUP BY win, a, b),
e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY win, a) AS BIGINT) AS outgoing FROM e0)"""
    )


SURPRISE = """s AS (SELECT win, b AS tid, n, outgoing, CASE WHEN n < 2 OR outgoing = 0 THEN 0 WHEN n * 50 < outgoing THEN 90 WHEN n * 20 < outgoing THEN 75
    WHEN n * 10 < outgoing THEN 50 WHEN n * 5 < outgoing THEN 25 ELSE 0 END AS surprise
    FROM (SELECT *, row_number() OVER (PARTITION BY win, b ORDER BY n / outgoing DESC, n DESC) AS r FROM e) WHERE r = 1)"""


def _kl() -> str:
    """Divergences over rows (a, b, na, nb, k): a, b null where a side lacks the key, k keys in all."""
    p, q = "((coalesce(b, 0) + 1) / (nb + k))", "((coalesce(a, 0) + 1) / (na + k))"
    m = f"(({p} + {q}) / 2)"
    return f"greatest(0, sum({p} * log2({p} / {q}))) AS kl, least(1, greatest(0, sum(0.5 * {p} * log2({p} / {m}) + 0.5 * {q} * log2({q} / {m})))) AS js"


def stability(**kw) -> str:
    return (
        counts(**kw)
        + f""",
tot AS (SELECT DISTINCT win, lines FROM cnt),
pairs AS (SELECT c.win, c.lines AS nb, p.lines AS na FROM tot c JOIN tot p ON p.win = c.win - 1),
u AS (SELECT win, tid FROM cnt UNION SELECT win + 1, tid FROM cnt),
d AS (SELECT u.win, u.tid, p.n AS a, c.n AS b, na, nb, count(*) OVER (PARTITION BY u.win) AS k FROM u JOIN pairs ON pairs.win = u.win
    LEFT JOIN cnt p ON p.win = u.win - 1 AND p.tid = u.tid LEFT JOIN cnt c ON c.win = u.win AND c.tid = u.tid),
x AS (SELECT win, {_kl()}, count(*) FILTER (a IS NULL) AS fresh, count(*) FILTER (b IS NULL) AS gone FROM d GROUP BY win)"""
    )


def reservoir(ring: str = "0", **kw) -> str:
    """CTE held: the reservoir with slot, salience and axis, over counts, edges and labels of ten-day windows."""
    kw = {"window": "w10"} | kw
    e = edges(ring=ring, **kw).split("WITH ", 1)[1]
    rest = counts(**kw).split("),\npos AS", 1)[1]
    return (
        "WITH "
        + e
        + ",\npos AS"
        + rest
        + f""",
{SURPRISE},
lab AS (SELECT win, tid, any_value(level) AS level, any_value(role) AS role FROM ev GROUP BY win, tid),
cand AS (SELECT cnt.win, cnt.tid, n, lines, rk, level, role, coalesce(s.surprise, 0) AS surprise,
    CASE WHEN cnt.n < 2 THEN 0 WHEN first * 10 > lines * 9 THEN 60 WHEN first * 4 > lines * 3 THEN 40 WHEN first * 2 > lines THEN 20 ELSE 0 END AS novelty,
    CASE WHEN role = 3 THEN 90 ELSE 0 END AS b1, CASE level WHEN 5 THEN 100 WHEN 4 THEN 80 WHEN 3 THEN 30 ELSE 0 END AS b2, CASE WHEN tmpl LIKE 'error %' THEN 70 ELSE 0 END AS b3
    FROM (SELECT win, tid, tmpl, n, lines, rk, first FROM cnt WHERE rk > 16) cnt JOIN lab USING (win, tid) LEFT JOIN (SELECT win, tid, surprise FROM s) s USING (win, tid)),
scored AS (SELECT *, greatest(b1, b2, b3, surprise, novelty) AS best, CASE WHEN n * 1000 < lines THEN 100 WHEN n * 100 < lines THEN 90 WHEN n * 10 < lines THEN 60 ELSE 30 END AS rarity FROM cand),
sal AS (SELECT *, best * rarity AS salience, CASE best WHEN b1 THEN 'terminator' WHEN b2 THEN 'level' WHEN b3 THEN 'failure_cue' WHEN surprise THEN 'structural_surprise' ELSE 'novelty' END AS axis,
    role = 3 OR level IN (4, 5) AS err FROM scored WHERE best > 0),
ph AS (SELECT *, CASE WHEN err AND row_number() OVER (PARTITION BY win, err ORDER BY salience DESC, tid) <= 4 THEN 1 ELSE 2 END AS phase FROM sal),
kd AS (SELECT *, row_number() OVER (PARTITION BY win, phase, role, level ORDER BY salience DESC, tid) AS kind FROM ph),
sl AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY phase, salience DESC, tid) AS slot FROM kd WHERE phase = 1 OR kind <= 4),
held AS (SELECT * FROM sl WHERE slot <= 16)"""
    )


def cube(base: str | None = None) -> str:
    """CTE cell(win, level, comp, role, n, closed), from CTE base(win, level, comp, role, n)."""
    base = base or "base AS (SELECT win, level, comp, role, count(*) AS n FROM ev GROUP BY ALL)"
    return f"""{base},
masks AS (SELECT unnest(range(8)) AS m),
gen AS (SELECT win, m, level AS l0, comp AS c0, role AS r0, CASE WHEN m & 1 > 0 THEN level END AS level, CASE WHEN m & 2 > 0 THEN comp END AS comp, CASE WHEN m & 4 > 0 THEN role END AS role, n
    FROM base, masks WHERE m & 2 = 0 OR comp IS NOT NULL),
cell AS (SELECT win, m, level, comp, role, CAST(sum(n) AS BIGINT) AS n,
    NOT ((m & 1 = 0 AND count(DISTINCT l0) = 1) OR (m & 2 = 0 AND count(c0) = count(*) AND count(DISTINCT c0) = 1) OR (m & 4 = 0 AND count(DISTINCT r0) = 1)) AS closed
    FROM gen GROUP BY win, m, level, comp, role)"""


CELL = "win AS window_id, CAST(level AS BIGINT) AS level, comp AS component, CAST(role AS BIGINT) AS role, n AS count"


def border(side: str) -> str:
    up = "x.win = y.win AND x.m | {bit} = y.m AND x.m <> y.m AND x.level IS NOT DISTINCT FROM {l} AND x.comp IS NOT DISTINCT FROM {c} AND x.role IS NOT DISTINCT FROM {r}"
    parts = []
    for bit, cols in ((1, ("NULL", "y.comp", "y.role")), (2, ("y.level", "NULL", "y.role")), (4, ("y.level", "y.comp", "NULL"))):
        parts.append("(" + up.format(bit=bit, l=cols[0], c=cols[1], r=cols[2]) + ")")
    return (
        ev()
        + ",\n"
        + cube()
        + f""",
wins AS (SELECT DISTINCT win FROM ev),
new AS (SELECT c.* FROM cell c WHERE c.win - 1 IN (SELECT win FROM wins) AND NOT EXISTS (SELECT 1 FROM cell p WHERE p.win = c.win - 1 AND p.m = c.m
    AND p.level IS NOT DISTINCT FROM c.level AND p.comp IS NOT DISTINCT FROM c.comp AND p.role IS NOT DISTINCT FROM c.role)),
hit AS ({" UNION ALL ".join(f"SELECT x.win AS pw, x.m AS pm, x.level AS pl, x.comp AS pc, x.role AS pr, y.win AS kw, y.m AS km, y.level AS kl, y.comp AS kc, y.role AS kr FROM new x JOIN new y ON {p}" for p in parts)})
SELECT {CELL} FROM new n WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE """
        + ("h.kw = n.win AND h.km = n.m AND h.kl IS NOT DISTINCT FROM n.level AND h.kc IS NOT DISTINCT FROM n.comp AND h.kr IS NOT DISTINCT FROM n.role)" if side == "upper" else "h.pw = n.win AND h.pm = n.m AND h.pl IS NOT DISTINCT FROM n.level AND h.pc IS NOT DISTINCT FROM n.comp AND h.pr IS NOT DISTINCT FROM n.role)")
    )


SPANS = """WITH sp AS (SELECT year(o_orderdate) AS win, o_orderkey AS span, 'order ' || o_orderstatus AS tmpl, n_name AS comp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
kid AS (SELECT year(l_shipdate) AS win, l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS parent, 'line ' || l_returnflag AS tmpl, n_name AS comp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
res AS (SELECT kid.win, kid.seq, kid.tmpl AS child, kid.comp AS callee, sp.tmpl AS parent, sp.comp AS caller, sp.span IS NOT NULL AS found FROM kid LEFT JOIN sp ON sp.win = kid.win AND sp.span = kid.parent)"""
SERVICE = SPANS + """,
e AS (SELECT win, caller, callee, count(*) AS n FROM res WHERE found AND caller <> callee GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, caller, callee) AS rk FROM e)"""


def halves(k: int = 16) -> str:
    """counts over half months, with top lists and both sides' totals."""
    return (
        counts(window="w15", component="svc")
        + f""",
top AS (SELECT * FROM cnt WHERE rk <= {k}),
tl AS (SELECT max(lines) FILTER (win = 0) AS na, max(lines) FILTER (win = 1) AS nb FROM cnt),
dd AS (SELECT coalesce(p.tid, c.tid) AS tid, p.n AS a, c.n AS b FROM (SELECT * FROM top WHERE win = 0) p FULL JOIN (SELECT * FROM top WHERE win = 1) c ON p.tid = c.tid)"""
    )


COMPOSED = """,
m0 AS (SELECT tid, CAST(sum(n) AS BIGINT) AS n FROM top WHERE win IN (0, 1) GROUP BY tid),
m AS (SELECT *, row_number() OVER (ORDER BY n DESC, tid) AS rk FROM m0),
ln AS (SELECT na + nb AS lines, na + nb - (SELECT sum(n) FROM m) AS residual FROM tl)"""


def oracle_sql() -> dict[str, str]:
    out = {}
    out["template_ids"] = ev(template="fine") + " SELECT DISTINCT tid AS template_id, tmpl AS template_str FROM ev"
    out["window_top_k"] = counts() + f" SELECT win AS window_id, rk AS rank, tid AS template_id, tmpl AS template_str, n AS count, {r6('n / lines')} AS frequency FROM cnt WHERE rk <= 16"
    out["window_entropy"] = counts() + f" SELECT win AS window_id, any_value(lines) AS lines, count(*) AS unique_templates, {r6(H('n', 'lines'))} AS entropy_bits FROM cnt GROUP BY win"
    tail = "t AS (SELECT *, sum(n) OVER (PARTITION BY win) AS tm FROM {src}), s AS (SELECT win, CAST(sum(n) AS BIGINT) AS tail_count, count(*) AS tail_unique, {h} AS e, max(n) / max(lines) AS mx FROM t GROUP BY win)"
    out["tail_summary"] = counts() + ", " + tail.format(src="cnt WHERE rk > 16", h=H("n", "tm")) + f" SELECT w.win AS window_id, coalesce(tail_count, 0) AS tail_count, coalesce(tail_unique, 0) AS tail_unique, {r6('e')} AS tail_entropy_bits, {r6('mx')} AS tail_max_rate FROM (SELECT DISTINCT win FROM cnt) w LEFT JOIN s USING (win)"
    pick = ", c AS (SELECT win, tmpl, {x} AS x, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY win, tmpl ORDER BY n DESC, x {d}) AS rk FROM c)"
    out["dominant_level"] = ev(template="kmod") + pick.format(x="level", d="DESC") + " SELECT win AS window_id, tmpl AS template_str, CAST(x AS BIGINT) AS level, false AS level_declared FROM r WHERE rk = 1"
    out["dominant_role"] = ev(template="kmod") + pick.format(x="role", d="DESC") + " SELECT win AS window_id, tmpl AS template_str, CAST(x AS BIGINT) AS role FROM r WHERE rk = 1"
    out["dominant_component"] = ev(template="kmod", component="svc") + pick.format(x="comp", d="ASC") + " SELECT win AS window_id, tmpl AS template_str, x AS component FROM r WHERE rk = 1"
    out["first_seen_rank"] = counts() + " SELECT win AS window_id, tid AS template_id, first AS first_seen, iid AS internal_id FROM cnt"
    out["new_vanished"] = stability(template="fine") + " SELECT win AS window_id, fresh AS new_templates, gone AS vanished_templates FROM x"
    out["stability_kl_js"] = stability() + f" SELECT win AS window_id, {r6('kl')} AS kl_divergence, {r6('js')} AS js_divergence, {r6('1 - js')} AS stability_score FROM x"
    out["window_spine"] = ev() + " SELECT unnest(range(min(win), max(win) + 1)) AS window_id FROM ev"
    out["ngram_bigrams"] = top_grams(2)
    out["ngram_trigrams"] = top_grams(3, window="w10")
    out["ngram_trace_scoped"] = top_grams(2, 1 << 30, "usr", window="w10", template="type")
    out["ngram_key_cap_dropped"] = grams(2, window="w10", template="fine") + " SELECT win AS window_id, count(*) FILTER (seen <= 200) AS admitted_keys, CAST(coalesce(sum(n) FILTER (seen > 200), 0) AS BIGINT) AS dropped_ngram_observations FROM k1 GROUP BY win"
    out["graph_edges"] = edges() + " SELECT win AS window_id, a AS from_id, b AS to_id, n AS count, outgoing FROM e"
    branch = f", bb AS (SELECT win, a, count(*) AS fanout, max(outgoing) AS total, {H('n', 'outgoing')} AS h FROM e GROUP BY win, a), br AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY round(h, 12) DESC, total DESC, a) AS rk FROM bb) SELECT win AS window_id, a AS template_id, fanout, total, {r6('h')} AS entropy_bits FROM br WHERE rk <= 64"
    out["branching_entropy"] = edges() + branch
    out["branching_trigram"] = edges(3) + branch
    path = edges() + ",\npos AS" + counts(window="w10").split("),\npos AS", 1)[1]
    out["dominant_path"] = path.replace("WITH raw", "WITH RECURSIVE raw", 1) + """,
nx AS (SELECT win, a, b FROM (SELECT e.*, row_number() OVER (PARTITION BY e.win, a ORDER BY e.n DESC, c.iid) AS r FROM e JOIN cnt c ON c.win = e.win AND c.tid = e.b) WHERE r = 1),
walk AS (SELECT win, 0 AS step, tid, [tid] AS path FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, iid) AS r FROM cnt) WHERE r = 1
    UNION ALL SELECT w.win, step + 1, nx.b, list_append(path, nx.b) FROM walk w JOIN nx ON nx.win = w.win AND nx.a = w.tid WHERE step < 8 AND NOT list_contains(path, nx.b))
SELECT win AS window_id, CAST(step AS BIGINT) AS step, tid AS template_id FROM walk"""
    out["surprise_band"] = edges() + ", " + SURPRISE + " SELECT win AS window_id, tid AS template_id, n AS edge_count, outgoing AS source_outgoing, CAST(surprise AS BIGINT) AS surprise FROM s"
    out["novelty"] = counts(window="w10", template="fine") + " SELECT win AS window_id, tid AS template_id, CAST(CASE WHEN n < 2 THEN 0 WHEN first * 10 > lines * 9 THEN 60 WHEN first * 4 > lines * 3 THEN 40 WHEN first * 2 > lines THEN 20 ELSE 0 END AS BIGINT) AS novelty FROM cnt"
    out["salience_reservoir"] = reservoir() + " SELECT win AS window_id, slot, tid AS template_id, n AS count, CAST(salience AS BIGINT) AS salience, axis AS retention_axis FROM held"
    out["tail_after_reservoir"] = reservoir() + ", " + tail.format(src="cnt WHERE rk > 16 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.win = cnt.win AND h.tid = cnt.tid)", h=H("n", "tm")).replace("s AS", "ts AS") + f" SELECT w.win AS window_id, coalesce(tail_count, 0) AS tail_count, coalesce(tail_unique, 0) AS tail_unique, {r6('e')} AS tail_entropy_bits FROM (SELECT DISTINCT win FROM cnt) w LEFT JOIN ts USING (win)"
    out["cube_base"] = ev() + ",\n" + cube() + f" SELECT {CELL} FROM base"
    out["cube_raw"] = ev() + ",\n" + cube() + f" SELECT {CELL} FROM cell"
    out["cube_closed"] = ev() + ",\n" + cube() + f" SELECT {CELL} FROM cell WHERE closed"
    out["cube_cardinality"] = ev() + ",\n" + cube() + " SELECT win AS window_id, count(DISTINCT level) AS level_cardinality, count(DISTINCT comp) AS component_cardinality, count(DISTINCT role) AS role_cardinality, count(*) AS closed_cells FROM cell WHERE closed GROUP BY win"
    out["cube_emerging_upper"], out["cube_emerging_lower"] = border("upper"), border("lower")
    out["acquisition"] = ev() + ",\n" + cube() + " SELECT ev.win AS window_id, count(comp) AS located_records, count(DISTINCT comp) AS components, count(DISTINCT level) AS levels, count(DISTINCT role) AS roles, any_value(k.n) AS closed_cells FROM ev JOIN (SELECT win, count(*) AS n FROM cell WHERE closed GROUP BY win) k USING (win) GROUP BY ev.win"
    values = ", v0 AS (SELECT win, tid, seq, 0 AS i, CAST(usr AS VARCHAR) AS v FROM ev UNION ALL SELECT win, tid, seq, 1, CAST(k AS VARCHAR) FROM ev), v1 AS (SELECT win, tid, i, v, count(*) AS n, min(seq) AS first FROM v0 GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY win, tid, i ORDER BY first) AS seen, sum(n) OVER (PARTITION BY win, tid, i) AS total FROM v1)"
    out["field_histogram_capped"] = ev(window="w10", template="type") + values + f" SELECT win AS window_id, tid AS template_id, CAST(i AS BIGINT) AS param_index, CAST(any_value(total) AS BIGINT) AS total, count(*) FILTER (seen <= 8) AS kept_values, CAST(sum(n) FILTER (seen <= 8) AS BIGINT) AS kept_count, {r6('sum(n * (log2(total) - log2(n)) / total) FILTER (seen <= 8)')} AS entropy_bits FROM v GROUP BY win, tid, i"
    out["histogram_js"] = ev(window="w15", template="type") + values + ", h AS (SELECT *, sum(n) OVER (PARTITION BY win, tid) AS tot FROM v WHERE i = 1 AND seen <= 64), p AS (SELECT * FROM h WHERE win = 0), c AS (SELECT * FROM h WHERE win = 1), tt AS (SELECT tid, max(tot) FILTER (win = 0) AS na, max(tot) FILTER (win = 1) AS nb FROM h GROUP BY tid), u AS (SELECT DISTINCT tid, v FROM h WHERE win IN (0, 1)), d AS (SELECT u.tid, p.n AS a, c.n AS b, na, nb, count(*) OVER (PARTITION BY u.tid) AS k FROM u JOIN tt ON tt.tid = u.tid LEFT JOIN p ON p.tid = u.tid AND p.v = u.v LEFT JOIN c ON c.tid = u.tid AND c.v = u.v), x AS (SELECT tid, " + _kl() + f" FROM d WHERE na > 0 AND nb > 0 GROUP BY tid) SELECT tid AS template_id, {r6('js')} AS js_divergence FROM x"
    binned = ", bins AS (SELECT *, CASE WHEN ns < 2 THEN 0 ELSE least(47, length(bin(ns)) - 1) END AS bin FROM ev)"
    out["ordinal_histogram"] = ev(window="w10", template="type") + binned + " SELECT win AS window_id, tid AS template_id, 'latency_ms' AS field_name, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM bins GROUP BY ALL"
    out["w1_latency_shift"] = ev(window="w15", template="type", component="svc", slow=True) + binned + f""",
g AS (SELECT unnest(range(48)) AS bin), tt AS (SELECT comp, count(*) FILTER (win = 0) AS na, count(*) FILTER (win = 1) AS nb FROM bins GROUP BY comp),
f AS (SELECT tt.comp, g.bin, na, nb, (SELECT count(*) FROM bins b WHERE b.comp = tt.comp AND b.win = 0 AND b.bin <= g.bin) AS ca, (SELECT count(*) FROM bins b WHERE b.comp = tt.comp AND b.win = 1 AND b.bin <= g.bin) AS cb FROM tt, g WHERE least(na, nb) >= 32),
s AS (SELECT comp, any_value(na) AS na, any_value(nb) AS nb, sum(abs(cb * na - ca * nb)) AS num, sum(cb * na - ca * nb) AS sg FROM f GROUP BY comp),
z AS (SELECT *, CASE WHEN num >= 5 * na * nb THEN 'High' WHEN num >= 2 * na * nb THEN 'Med' WHEN 2 * num >= na * nb THEN 'Low' ELSE 'None' END AS shift, CASE WHEN sg < 0 THEN 'Up' WHEN sg > 0 THEN 'Down' ELSE 'None' END AS dir FROM s)
SELECT comp AS component, na AS previous_total, nb AS current_total, {r6("num / (na * nb)")} AS octaves, shift, dir AS direction, CASE WHEN shift <> 'None' THEN CASE WHEN dir = 'Down' THEN 'down_' ELSE 'up_' END || lower(shift) END AS label FROM z"""
    out["service_edges"] = SERVICE + " SELECT win AS window_id, caller, callee, n AS count FROM r WHERE rk <= 100"
    out["service_edges_dropped"] = SERVICE + " SELECT win AS window_id, count(*) FILTER (rk > 100) AS dropped_edges FROM r GROUP BY win"
    out["span_edges"] = SPANS + f", e AS (SELECT win, {TID.format('parent')} AS p, {TID.format('child')} AS c, count(*) AS n FROM res WHERE found GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, p, c) AS rk FROM e) SELECT win AS window_id, rk AS rank, p AS parent_template, c AS child_template, n AS count FROM r WHERE rk <= 32"
    out["orphan_edges"] = SPANS + " SELECT win AS window_id, count(*) FILTER (NOT found) AS orphan_parent_edges, count(*) FILTER (found) AS resolved_edges FROM res GROUP BY win"
    out["active_spans_capped"] = SPANS + ", r AS (SELECT win, span, row_number() OVER (PARTITION BY win ORDER BY span DESC) AS rk FROM sp) SELECT win AS window_id, span AS span_id FROM r WHERE rk <= 50"
    out["template_deltas"] = halves() + " SELECT tid AS template_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'vanished' ELSE 'common' END AS state, a AS previous_count, b AS current_count, coalesce(b, 0) - coalesce(a, 0) AS delta, row_number() OVER (ORDER BY abs(coalesce(b, 0) - coalesce(a, 0)) DESC, tid) AS rank FROM dd"
    out["diff_divergence"] = halves() + ", d AS (SELECT *, count(*) OVER () AS k FROM dd, tl), x AS (SELECT " + _kl() + f" FROM d) SELECT {r6('kl')} AS kl_divergence, {r6('js')} AS js_divergence, {r6('1 - js')} AS stability_score FROM x"
    two = top_grams(2, window="w15", component="svc").rsplit("\nSELECT", 1)[0]
    out["diff_ngrams"] = two + f", z AS (SELECT coalesce(p.sequence, c.sequence) AS sequence, p.p AS a, c.p AS b FROM (SELECT * FROM t WHERE win = 0 AND rk <= 32) p FULL JOIN (SELECT * FROM t WHERE win = 1 AND rk <= 32) c ON p.sequence = c.sequence) SELECT CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'vanished' ELSE 'rate_changed' END AS state, sequence, {r6('a')} AS previous_probability, {r6('b')} AS current_probability FROM z WHERE a IS DISTINCT FROM b"
    out["compose_ngrams"] = two + f", z AS (SELECT sequence, CAST(sum(n) AS BIGINT) AS n, sum(n) / sum(n / p) AS p FROM t WHERE win IN (0, 1) AND rk <= 32 GROUP BY sequence), y AS (SELECT *, row_number() OVER (ORDER BY n DESC, sequence) AS r FROM z) SELECT r AS rank, sequence, n AS count, {r6('p')} AS probability FROM y WHERE r <= 32"
    out["compose_pair_top_k"] = halves() + COMPOSED + f" SELECT rk AS rank, tid AS template_id, n AS count, {r6('n / lines')} AS frequency FROM m, ln WHERE rk <= 16"
    out["compose_tail"] = halves() + COMPOSED + f""",
tv AS (SELECT n FROM m WHERE rk > 16), tn AS (SELECT coalesce(sum(n), 0) AS v, count(*) AS u FROM tv), all_ AS (SELECT n FROM m UNION ALL SELECT residual FROM ln WHERE residual > 0),
te AS (SELECT n FROM tv UNION ALL SELECT residual FROM ln WHERE residual > 0)
SELECT CAST(lines AS BIGINT) AS lines, CAST(v + residual AS BIGINT) AS tail_count, u AS tail_unique, {r6("(SELECT sum(n * (log2(lines) - log2(n)) / lines) FROM all_)")} AS entropy_bits,
    CASE WHEN u > 0 THEN {r6("(SELECT sum(n * (log2(v + residual) - log2(n)) / (v + residual)) FROM te)")} END AS tail_entropy_bits FROM ln, tn"""
    out["compose_cube"] = ev(window="w15", component="svc") + ",\n" + cube(base="base AS (SELECT 0 AS win, level, comp, role, count(*) AS n FROM ev WHERE win IN (0, 1) GROUP BY ALL)") + " SELECT CAST(level AS BIGINT) AS level, comp AS component, CAST(role AS BIGINT) AS role, n AS count FROM cell WHERE closed"
    out["presence_churn"] = ev(template="fine") + """, days AS (SELECT unnest(range(min(win), max(win) + 1)) AS win FROM ev), tt AS (SELECT DISTINCT tid FROM ev),
here AS (SELECT tt.tid, days.win, EXISTS (SELECT 1 FROM ev WHERE ev.win = days.win AND ev.tid = tt.tid) AS p FROM tt, days),
l AS (SELECT *, lag(p) OVER (PARTITION BY tid ORDER BY win) AS q FROM here)
SELECT tid AS template_id, count(*) AS span, count(*) FILTER (q IS NOT NULL AND p <> q) AS transitions, arg_min(p, win) AS present_first, arg_max(p, win) AS present_last FROM l GROUP BY tid"""
    out["reservoir_delta"] = reservoir("usr", window="w15", component="svc") + """, kept AS (SELECT win, tid, n, false AS salient FROM cnt WHERE rk <= 16 UNION ALL SELECT win, tid, n, true FROM held),
p AS (SELECT * FROM kept WHERE win = 0), c AS (SELECT * FROM kept WHERE win = 1)
SELECT 'new_salient' AS kind, tid AS template_id, CAST(NULL AS BIGINT) AS previous_count, n AS current_count FROM c WHERE salient AND tid NOT IN (SELECT tid FROM p)
UNION ALL SELECT 'vanished_salient', tid, n, NULL FROM p WHERE salient AND tid NOT IN (SELECT tid FROM c)"""
    out["cap_text"] = f"""WITH t AS (SELECT DISTINCT text FROM conversations), k AS (SELECT text, list_max(list_filter(range(0, 48), lambda x: strlen(left(text, x)) <= 47)) AS k FROM t),
c AS (SELECT text, CASE WHEN strlen(text) < 64 THEN text ELSE left(text, k) || repeat('~', 48 - strlen(left(text, k))) || substr(sha256(text), 1, 16) END AS capped FROM k)
SELECT {TID.format('text')} AS text_id, capped, strlen(capped) = 64 AS digest FROM c WHERE text IS NOT NULL"""
    out["conversation_bigrams"] = f"WITH l AS (SELECT lag({TID.format('role')}) OVER (PARTITION BY conv_id ORDER BY turn) AS a, {TID.format('role')} AS b FROM conversations), c AS (SELECT a, b, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY ALL) SELECT a || '>' || b AS sequence, n AS count, {r6('n / sum(n) OVER (PARTITION BY a)')} AS probability FROM c"
    out["admission_budget"] = ev(template="fine") + ", known AS (SELECT DISTINCT tid FROM ev WHERE win = 0), fresh AS (SELECT tid FROM (SELECT tid, row_number() OVER (ORDER BY min(seq)) AS r FROM ev WHERE win > 0 AND tid NOT IN (SELECT tid FROM known) GROUP BY tid) WHERE r <= 20) SELECT win AS window_id, count(*) AS events, count(DISTINCT tid) AS templates FROM ev WHERE win > 0 AND (tid IN (SELECT tid FROM known) OR tid IN (SELECT tid FROM fresh)) GROUP BY win"
    out["document_sources"] = """WITH e AS (SELECT source, lang, CASE WHEN toxic = 1 THEN 4 WHEN quality = 0 THEN 3 ELSE 2 END AS level FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT source, level, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, level DESC) AS r FROM e GROUP BY source, level), c AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM e GROUP BY source, lang),
n AS (SELECT source, count(*) AS n FROM e GROUP BY source)
SELECT n.source AS template_str, n AS count, CAST(l.level AS BIGINT) AS level, c.lang AS component, row_number() OVER (ORDER BY n DESC, """ + TID.format("n.source") + """) AS rank FROM n JOIN l ON l.source = n.source AND l.r = 1 JOIN c ON c.source = n.source AND c.r = 1"""
    return out
