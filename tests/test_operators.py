import pytest
from helpers import events, lines
from pyspark.sql import functions as F

from fenestra.config import Config
from fenestra.operators import behavior, cube, histograms, reservoir, stats, topology
from fenestra.sources.events import admit, registry


def test_order_is_the_same_in_small_blocks(spark):
    from fenestra.operators.order import with_ordinal, with_previous

    e = events(spark, lines(" ".join("abcdefghij"[i * 7 % 10] for i in range(200)))).withColumn("seq", F.col("seq") * 13 + 5)
    got = with_ordinal(e, block=64).select("seq", "ordinal").orderBy("seq").collect()
    assert [r["ordinal"] for r in got] == list(range(200))
    prev = with_previous(with_ordinal(e), "template_str", 2, ["source", "window_id"], "ordinal", block=8).orderBy("ordinal").collect()
    names = [r["template_str"] for r in prev]
    assert [r["_prev1"] for r in prev] == [None, *names[:-1]] and [r["_prev2"] for r in prev] == [None, None, *names[:-2]]


def test_ngram_cap(spark):
    e = events(spark, [{"template_str": f"cap probe stage {i} completed"} for i in range(6000)])
    table, refused = behavior.ngrams(e, Config())
    r = refused.first()
    assert (r["admitted_keys"], r["dropped_ngram_observations"]) == (4096, 1903)
    assert behavior.top_ngrams(table, 32).count() == 32


def test_tiny_ngram_cap(spark):
    r = behavior.ngrams(events(spark, lines("a b c d e x x x x x")), Config(max_ngram_keys=4))[1].first()
    assert r["dropped_ngram_observations"] == 5


def test_ngram_probability(spark):
    e = events(spark, lines("alpha beta alpha gamma"))
    names = {r["template_id"]: r["template_str"] for r in registry(e).collect()}
    got = {tuple(names[i] for i in r["ids"]): r["probability"] for r in behavior.ngrams(e)[0].collect()}
    assert got[("alpha", "beta")] == 0.5 and got[("beta", "alpha")] == 1.0


@pytest.mark.parametrize("cap", [4096, 1])
def test_trace_scoping(spark, cap):
    rows = []
    for i in range(4):
        for k in (1, 2, 3):
            rows += [{"template_str": f"a{k}", "trace_id": 1000 + i}, {"template_str": f"b{k}", "trace_id": 2000 + i}]
    e = events(spark, rows)
    table = behavior.ngrams(e, Config(max_active_traces=cap))[0]
    # with one ring at a time every interleaved trace is evicted before its next event
    assert table.count() == (4 if cap > 1 else 0)
    assert behavior.ngrams(e, Config(trace_scoping_enabled=False))[0].count() == 6


def test_dominant_path_stops_on_itself(spark):
    e = events(spark, lines("a b c a b c a b d"))
    table = behavior.ngrams(e)[0]
    path = behavior.dominant_path(behavior.graph(table), stats.with_rank(stats.template_stats(e)), 8).orderBy("step").collect()
    names = {r["template_id"]: r["template_str"] for r in registry(e).collect()}
    assert [names[r["template_id"]] for r in path] == ["a", "b", "c"]


def test_dominant_labels_break_ties(spark):
    e = events(spark, [{"template_str": "t", "level": 2, "component": "zebra"}, {"template_str": "t", "level": 4, "component": "alpha", "role": 3}, {"template_str": "u", "level": 6}, {"template_str": "u", "level": 1}])
    rows = {r["template_str"]: r for r in stats.template_stats(e).collect()}
    assert (rows["t"]["level"], rows["t"]["component"], rows["t"]["role"]) == (4, "alpha", 3)
    assert (rows["u"]["level"], rows["u"]["component"]) == (1, None)


def test_rare_error_reaches_the_reservoir(spark):
    rows = [{"template_str": f"steady {i % 4}"} for i in range(400)] + [{"template_str": "disk gone", "level": 4}, {"template_str": "read error.txt", "level": 2}]
    e = events(spark, rows)
    ranks = stats.with_rank(stats.template_stats(e))
    found = reservoir.candidates(ranks, behavior.surprise(behavior.graph(behavior.ngrams(e)[0])), 3)
    held = reservoir.reservoir(found, Config(top_k_size=3, reservoir_size=8)).collect()
    assert [r["template_str"] for r in held] == ["disk gone"]
    t = stats.tail(ranks, 3, reservoir.reservoir(found, Config(top_k_size=3, reservoir_size=8))).first()
    assert (t["tail_unique"], t["tail_count"]) == (2, 101)


def _joint(spark, components: int, levels: range):
    return spark.range(components).select(F.lit("s").alias("source"), F.lit(0).cast("long").alias("window_id"), F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"), F.concat(F.lit("c"), "id").alias("component"), F.lit(0).alias("role"), F.lit(1).cast("long").alias("count"))


@pytest.mark.parametrize(("components", "levels", "band", "depth"), [(1500, range(2), 2, 1), (2000, range(6), 4, 0), (10, range(6), 0, 1)])
def test_cube_collapse(spark, components, levels, band, depth):
    joint = _joint(spark, components, levels)
    s = cube.collapse_states(joint).first()
    assert (s["band_floor"], s["floor_depth"]) == (band, depth)
    cells = cube.bounded(joint)
    assert cells.count() <= 4096
    if depth == 0:
        failures = {r["level"]: r["count"] for r in cells.where("level in (4, 5)").collect()}
        assert failures == {4: 2000, 5: 2000}


def test_closed_cells_match_brute_force(spark):
    import random
    from itertools import product

    rng = random.Random(5)
    base = {(rng.randrange(3), rng.choice(["x", "y", None]), rng.randrange(2)): rng.randrange(1, 5) for _ in range(9)}
    frame = spark.createDataFrame([("s", 0, *k, n) for k, n in base.items()], "source string, window_id long, level int, component string, role int, count long")
    want = {}
    for mask in product((0, 1), repeat=3):
        groups: dict = {}
        for k, n in base.items():
            if mask[1] and k[1] is None:
                continue
            groups.setdefault(tuple(v if m else None for v, m in zip(k, mask, strict=True)), []).append((k, n))
        for cell, members in groups.items():
            starred = [i for i in range(3) if not mask[i]]
            if not any(len({m[0][i] for m in members}) == 1 and members[0][0][i] is not None for i in starred):
                want[(mask, cell)] = sum(n for _, n in members)
    got = cube.closed(frame).collect()
    assert sorted((str(tuple((r["pinned"] >> i) & 1 for i in range(3))), str((r["level"], r["component"], r["role"])), r["count"]) for r in got) == sorted((str(m), str(c), n) for (m, c), n in want.items())


def test_cube_burst_border(spark):
    row = lambda w, level, comp, n: [{"window_id": w, "template_str": "t", "level": level, "component": comp}] * n
    joint = cube.base(events(spark, row(0, 2, "auth", 6) + row(1, 2, "auth", 6) + row(1, 4, "db", 5)))
    before, after = joint.where("window_id = 0"), joint.where("window_id = 1").withColumn("window_id", F.lit(0).cast("long"))
    got = {(r["side"], r["level"], r["component"], r["role"]): r["count"] for r in cube.border(before, after, ["source", "window_id"]).collect()}
    assert got == {("upper", 4, None, None): 5, ("upper", None, "db", None): 5, ("lower", 4, "db", 0): 5}


def test_service_edges_over_the_cap(spark):
    edges = [("api", "db", 5), ("api", "cache", 4), ("gateway", "auth", 2), ("gateway", "billing", 2), ("worker", "queue", 2)]
    rows, span = [], 0
    for caller, callee, n in edges:
        for _ in range(n):
            rows += [{"template_str": caller, "component": caller, "is_span": True, "span_id": span}, {"template_str": callee, "component": callee, "is_span": True, "span_id": span + 1, "parent_span_id": span}]
            span += 2
    rows.append({"template_str": "lost", "component": "lost", "is_span": True, "span_id": 999, "parent_span_id": 99_999})
    e = events(spark, rows)
    resolved = topology.resolve(e.where("parent_span_id is not null").select("source", "window_id", "seq", "parent_span_id", "template_id", "component"), topology.active_spans(e, 0))
    kept, dropped = topology.service_edges(resolved, None, 3)
    assert sorted((r["caller"], r["callee"], r["count"]) for r in kept.collect()) == [("api", "cache", 4), ("api", "db", 5), ("gateway", "auth", 2)]
    assert dropped.first()["dropped_edges"] == 2 and topology.orphans(resolved).first()["orphan_parent_edges"] == 1


def test_w1_bands(spark):
    frame = lambda b, n: spark.createDataFrame([("c", b, n)], "component string, bin int, n long")
    for shift, want in ((10, "High"), (5, "High"), (3, "Med"), (2, "Med"), (1, "Low"), (0, "None")):
        r = histograms.w1_shift(frame(26, 40), frame(26 + shift, 40), ["component"]).first()
        assert (r["octaves"], r["shift"]) == (shift, want) and r["direction"] == ("Up" if shift else "None")
    assert histograms.w1_shift(frame(36, 40), frame(26, 40), ["component"]).first()["direction"] == "Down"
    assert histograms.w1_shift(frame(26, 31), frame(36, 40), ["component"]).count() == 0


def test_histogram_value_cap(spark):
    rows = [{"template_str": f"t{t}", "params": [f"v{i}", f"w{i}"]} for t in range(3) for i in range(100)] + [{"template_str": "t0", "params": ["v0", "new"]}]
    h = histograms.field_histograms(events(spark, rows), 2, 64).collect()
    assert {r["kept_values"] for r in h} == {64} and len(h) == 6
    slot = next(r for r in h if r["total"] == 101 and r["param_index"] == 0)
    assert slot["kept_count"] == 65 and slot["cardinality"] == pytest.approx(100, abs=3)


def test_stability_skips_the_window_after_an_empty_one(spark):
    e = events(spark, lines("a b", window_id=0) + lines("a c", window_id=1) + lines("a", window_id=3))
    got = {r["window_id"]: (r["new_templates"], r["vanished_templates"]) for r in stats.stability(stats.template_stats(e)).collect()}
    assert got == {1: (1, 1)}


def test_admission(spark):
    e = events(spark, lines("a b c b d a"))
    known = registry(events(spark, lines("a")))
    assert sorted(r["template_str"] for r in admit(e, known, budget=1).collect()) == ["a", "a", "b", "b"]
    assert sorted(r["template_str"] for r in admit(e, known, predicate=F.col("template_str") == "d").collect()) == ["a", "a", "d"]


def test_base_recovered_from_closed_cells(spark):
    rows = [{"template_str": "t", "level": 2 + i % 3, "component": [None, "a", "b"][i % 3 if i % 4 else 0], "role": i % 2} for i in range(40)]
    joint = cube.base(events(spark, rows))
    closed = cube.closed(joint)
    cols = ["level", "component", "role", "count"]
    key = lambda r: str(tuple(r))
    assert sorted(joint.select(*cols).collect(), key=key) == sorted(cube.recover_base(closed).select(*cols).collect(), key=key)
    every = cube.cells(joint)
    assert sorted(every.select(*cols).collect(), key=key) == sorted(cube.counts_in(closed, every).select(*cols).collect(), key=key)


def test_where_paths_are_a_tree(spark):
    paths = spark.createDataFrame([(["a", "x"],), (["b", "y"],), (["a"],)], "path array<string>")
    assert cube.tree_conflicts(paths).count() == 0
    assert [r["value"] for r in cube.tree_conflicts(paths.union(spark.createDataFrame([(["b", "x"],)], "path array<string>"))).collect()] == ["x"]


def test_display_form(spark):
    from fenestra.functions import text as T

    frame = spark.createDataFrame([("a" * 100,), ("short",)], "t string").select(T.cap_text(F.col("t"), 64).alias("c"))
    assert [r[0] for r in frame.select(T.display_form(F.col("c"), 64)).collect()] == ["a" * 47 + "…", "short"]


def test_span_ids_that_come_again(spark):
    spans = [{"template_str": f"{i}-{k}", "is_span": True, "span_id": i} for k, i in enumerate([1, 2, 1, 3, 4, 1, 3])]
    e = events(spark, spans).select("source", "window_id", "seq", "span_id", "template_id", F.col("template_str").alias("component"))
    held = lambda cap: sorted((r["span_id"], r["component"]) for r in topology.active_spans(e, cap).collect())
    assert held(0) == held(4) == [(1, "1-0"), (2, "2-1"), (3, "3-3"), (4, "4-4")]  # the first record stays
    assert held(2) == [(1, "1-5"), (3, "3-6")]  # 1 and 3 were evicted and enter anew
    assert held(3) == [(1, "1-5"), (3, "3-3"), (4, "4-4")]


def test_no_bound_on_rings(spark):
    rows = [{"template_str": f"t{i % 3}", "trace_id": i % 5} for i in range(40)]
    free, bounded = (behavior.ngram_events(events(spark, rows), Config(max_active_traces=n)).count() for n in (0, 2))
    assert free == 35 and bounded == 0
