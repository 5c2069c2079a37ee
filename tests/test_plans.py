import json

import pytest
from helpers import events, lines
from pyspark.sql import functions as F

from fenestra.config import Config, SourceBlock
from fenestra.plans import compose, diff
from fenestra.plans.documents import fingerprint, to_json

C = Config(top_k_size=3, reservoir_size=4, max_param_histograms=1)


@pytest.fixture(scope="module")
def docs(spark):
    a = lines("a b a b a c d", window_id=0, component="auth", params=["x"]) + [{"template_str": "boom", "level": 4, "window_id": 0, "component": "db", "params": ["y"]}]
    b = lines("a b a b e e d", window_id=1, component="auth", params=["x"]) + [{"template_str": "boom", "level": 5, "window_id": 1, "component": "db", "params": ["z"]}]
    return fingerprint(events(spark, a + b), C)


def pair(docs):
    return docs.at("CASE WHEN window_id = 0 THEN 0 END"), docs.at("CASE WHEN window_id = 1 THEN 0 END")


def test_document_json(docs):
    got = {r["window_id"]: json.loads(r["json"]) for r in to_json(docs).collect()}
    d = got[0]
    assert d["window"]["lines_observed"] == 8 and [t["template"] for t in d["stats"]["top_k"]][0] == "a"
    assert d["stats"]["reservoir"][0]["level"] == "ERROR" and "extensions" not in d["stats"]["top_k"][0]
    assert d["stats"]["top_k"][0]["param_histograms"] == [{"param_index": 0, "value_counts": {"x": 3}, "total": 3, "approximate_cardinality": 1}]
    assert d["cube"]["cell_count"] == len(d["cube"]["cells"]) <= d["cube"]["raw_cell_count"] and d["cube"]["cell_budget"] == 4096
    assert [a["name"] for a in d["cube"]["axes"]] == ["level", "where", "structural_role"] and d["source"] == {}
    assert d["extensions"]["acquisition"]["where_cardinality_per_depth"] == [2] and "service_edges" not in d["extensions"]
    assert got[1]["stability"]["previous_window_end"] == d["window"]["end"]
    assert "stability" not in d and got[1]["stability"]["new_templates"] == 1


def test_diff_and_outcome(docs):
    d = diff.diff(*pair(docs))
    o = diff.outcome(d).first()
    assert o["comparison_outcome"] == "changed" and o["withheld_signals"] == []
    r = json.loads(diff.to_json(d, vendor="x.").first()["json"])
    assert r["comparison_outcome"] == "changed" and r["previous"]["window"]["end"] < r["current"]["window"]["start"]
    assert len(r["new_templates"]) == 1 and r["tail_delta"]["tail_template_count_delta"] == r["tail_delta"]["current_tail_template_count"] - r["tail_delta"]["previous_tail_template_count"]
    crossed = {(x["coord"].get("level"), x["previous_count"] > 0, x["current_count"] > 0) for s in ("emerging", "vanishing") for x in r["cube_diff"][s]["lower"]}
    assert ("FATAL", False, True) in crossed and ("ERROR", True, False) in crossed and [a["name"] for a in r["cube_diff"]["axes"]] == ["level", "where", "structural_role"]
    assert r["max_text_bytes"] == 64 and "incomparable_signals" not in r
    same = diff.outcome(diff.diff(pair(docs)[0], pair(docs)[0])).first()
    assert same["comparison_outcome"] == "unchanged" and same["witnesses"] == []


def test_compose_is_commutative(docs):
    a, b = pair(docs)
    left, right = (json.loads(to_json(c).first()["json"]) for c in (compose.compose(a, b), compose.compose(b, a)))
    assert left == right
    assert left["window"]["lines_observed"] == 16 and left["stats"]["top_k"][0]["count"] == 5
    assert left["stats"]["top_k"][0]["extensions"]["presence_churn"]["span_windows"] == 2
    assert "stability" not in left and set(left["extensions"]) == {"presence_churn_summary"} and [p["lines_observed"] for p in left["provenance"]] == [8, 8]
    assert left["extensions"]["presence_churn_summary"]["horizon"] == "top_k_union_reservoir"


def test_composed_entropy_counts_the_residual(spark):
    def doc(w, names):
        return [{"template_str": n, "window_id": w} for n in names for _ in range(64)]

    d = fingerprint(events(spark, doc(0, "ab") + doc(1, "cd")), Config(top_k_size=8))
    h = compose.compose(*pair(d)).header.first()
    assert h["entropy_bits"] == pytest.approx(2.0) and h["tail_count"] == 0
    tails = doc(0, "a") + [{"template_str": f"t{i}", "window_id": 0} for i in range(64)] + doc(1, "a") + [{"template_str": f"u{i}", "window_id": 1} for i in range(64)]
    h = compose.compose(*pair(fingerprint(events(spark, tails), Config(top_k_size=1)))).header.first()
    assert (h["lines"], h["tail_count"]) == (256, 128) and h["entropy_bits"] == pytest.approx(1.0)


def test_gates_refuse_other_contracts(docs):
    a, b = pair(docs)
    for change in ({"max_text_bytes": F.lit(128)}, {"max_text_bytes": F.lit(None).cast("int")}):
        other = type(b)(**{**b.__dict__, "header": b.header.withColumns(change)})
        with pytest.raises(Exception, match="max_text_bytes"):
            diff.diff_header(a.header, other.header).collect()
    named = lambda d, v: d.header.withColumn("retention_profile", F.lit(v))
    with pytest.raises(Exception, match="retention_profile"):
        compose.gates(named(a, "p"), named(b, "q"), "compose").collect()
    assert compose.gates(named(a, "p"), b.header, "compose").count() == 1


def test_incomparable_signals(docs):
    a, b = pair(docs)
    plain = type(b)(**{**b.__dict__, "header": b.header.withColumn("reservoir_size", F.lit(None).cast("int")).withColumn("ngram_size", F.lit(3)), "joint": None})
    got = {r["signal"]: (r["reason"], r["absent_in"]) for r in diff.incomparable(a, plain).collect()}
    assert got == {"reservoir_delta": ("absent_in_one_input", "current"), "cube_diff": ("absent_in_one_input", "current"), "ngram_delta": ("ngram_size_differs", None), "branching_delta": ("ngram_size_differs", None)}


def test_source_merge(spark):
    row = spark.sql("""SELECT named_struct('name', 'x', 'kind', 'k', 'host_count', 2, 'tags', map('a', '1', 'b', '2')) a,
        named_struct('name', 'y', 'kind', 'k', 'host_count', 3, 'tags', map('a', '1', 'b', '9')) b""")
    got = row.select(compose.common_source(F.col("a"), F.col("b"), ["name", "kind"]).alias("s"), compose.common_source(F.col("a"), F.col("a"), ["name", "kind"]).alias("t")).first()
    assert got["s"].asDict() == {"name": None, "kind": "k", "host_count": 5, "tags": {"a": "1"}} and got["t"]["host_count"] == 2


def test_values_that_are_not_finite_are_refused(docs):
    bad = type(docs)(**{**docs.__dict__, "header": docs.header.withColumn("entropy_bits", F.lit(float("nan")))})
    with pytest.raises(Exception, match="entropy_bits"):
        to_json(bad).collect()


def test_spans_sources_and_outcomes_on_the_wire(spark):
    span = lambda i, t, c, parent=None, links=None: {"template_str": t, "component": c, "is_span": True, "span_id": i, "parent_span_id": parent, "window_id": 0}
    rows = [span(1, "in", "api"), span(2, "query", "db", 1), span(3, "lost", "db", 99), {"template_str": "plain", "window_id": 1}]
    e = events(spark, rows).withColumn("linked_span_ids", F.when(F.col("span_id") == 2, F.array(F.lit(1), F.lit(77))).cast("array<bigint>"))
    ended = spark.createDataFrame([("events", 0, "Cancelled"), ("events", 1, "unknown")], "source string, window_id long, run_outcome string")
    block = SourceBlock(service="shop", host_count=2, tags=(("zone", "a"), ("env", "test")))
    docs = fingerprint(e, Config(top_k_size=4, source_block=block, source_ref="t"), outcomes=ended)
    got = {r["window_id"]: json.loads(r["json"]) for r in to_json(docs, vendor="x.").collect()}
    first = got[0]["extensions"]
    assert first["x.service_edges"] == {"edges": [{"caller": "api", "callee": "db", "weight": 1}, {"caller": "db", "callee": "api", "weight": 1}], "dropped_edges": 0}
    assert [x["count"] for x in first["x.span_edges"]["edges"]] == [1] and first["x.span_edges"]["span_edges_size"] == 32
    assert (first["x.acquisition"]["orphan_parent_edges"], first["x.acquisition"]["orphan_link_edges"], first["x.acquisition"]["span_records"]) == (1, 1, 3)
    assert got[0]["run_outcome"] == "aborted" and "run_outcome" not in got[1] and "x.service_edges" not in got[1]["extensions"]
    assert got[0]["source"] == {"service": "shop", "host_count": 2, "tags": {"env": "test", "zone": "a"}}
    assert got[0]["coordinate"]["source_ref"] == {"resolver_kind": "table", "handle": "t"}
    both = json.loads(to_json(compose.compose(*pair(docs))).first()["json"])
    assert both["source"] == got[0]["source"] and len(both["coordinate"]["children"]) == 2 and len(both["provenance"][0]["coordinate"]["bounds"]) == 2


def test_text_cap_is_kept_as_declared(spark):
    long = ["p" * 70 + str(i % 2) for i in range(6)]
    rows = [{"template_str": "t", "component": "c" * 90, "params": [long[i]]} for i in range(6)]
    (d,) = [json.loads(r["json"]) for r in to_json(fingerprint(events(spark, rows), Config(max_param_histograms=1), blocks={"histograms"})).collect()]
    entry = d["stats"]["top_k"][0]
    counts = entry["param_histograms"][0]["value_counts"]
    assert d["max_text_bytes"] == 64 and len(entry["component"]) == 64 and entry["component"][47] == "~"
    assert len(counts) == 2 and all(len(v) == 64 for v in counts) and entry["param_histograms"][0]["approximate_cardinality"] == 2


def test_malformed_bounds_are_refused(docs):
    a, b = pair(docs)
    for change in ({"end": F.lit(None).cast("timestamp")}, {"end": F.col("start") - F.expr("interval 1 second")}):
        with pytest.raises(Exception, match="malformed"):
            compose.gates(a.header, b.header.withColumns(change), "compose").collect()


def test_ordinals_of_other_schedules_shift_no_latency(spark):
    def side(w, ns, schedule):
        return [{"template_str": "t", "component": "pay", "window_id": w, "ns": ns, "schedule": schedule}] * 40

    for schedule, want in (("dur-log2-ns-v1", ["up_high"]), ("bytes-log2-v1", [])):
        rows = side(0, 1 << 10, schedule) + side(1, 1 << 20, schedule)
        e = events(spark, rows)
        values = spark.createDataFrame([(i, r["ns"], r["schedule"]) for i, r in enumerate(rows)], "seq long, ns long, sch string")
        e = e.drop("ordinals").join(values, "seq").withColumn("ordinals", F.array(F.struct(F.lit("x").alias("field_name"), F.col("sch").alias("schedule"), F.col("ns").alias("value")))).drop("ns", "sch")
        d = fingerprint(e, Config(max_param_histograms=1), blocks={"cube", "histograms"})
        a, b = pair(d)
        assert [r["latency_shift"] for r in diff.latency_shifts(a, b).collect()] == want
        shifts = {r["latency_shift"] for r in diff.cube_diff(a, b).collect()} - {None}
        assert shifts == set(want)


def test_errors_name_the_entry(docs):
    bad = type(docs)(**{**docs.__dict__, "rows": docs.rows.withColumn("frequency", F.when(F.col("place") == 2, F.lit(float("inf"))).otherwise(F.col("frequency")))})
    with pytest.raises(Exception, match=r"top_k\[1\]\.frequency|reservoir\[1\]\.frequency"):
        to_json(bad).collect()
