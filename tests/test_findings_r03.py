"""Faults named in FINDINGS_r03."""

import random

import pyarrow as pa
import pytest
from helpers import events
from pyspark.sql import functions as F

from fenestra.config import Config
from fenestra.operators import behavior, cube
from fenestra.plans.documents import fingerprint

STATES = [(b, d) for d in (1, 0) for b in (0, 2, 3, 4)]


def rows_made(df) -> int:
    """Rows that the plan's explodes and expands made."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("Generate", "Expand"):
            total += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def _wide(spark, components: int):
    return spark.range(components).select(F.lit("s").alias("source"), F.lit(0).cast("long").alias("window_id"), F.explode(F.array(*[F.lit(x) for x in range(6)])).alias("level"), F.concat(F.lit("c"), "id").alias("component"), F.lit(0).alias("role"), F.lit(1).cast("long").alias("count"))


@pytest.mark.parametrize("query", ["states", "bounded"])
def test_collapse_makes_no_row_per_component(spark, query):
    joint = spark.createDataFrame(_wide(spark, 3000).collect(), "source string, window_id long, level int, component string, role int, count long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = rows_made(cube.collapse_states(joint, 100) if query == "states" else cube.bounded(joint, 100))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < made < 3000


def test_state_counts_are_those_of_the_cells(spark):
    """Random joints, with absent values on every dimension."""
    rng, rows = random.Random(11), set()
    for w in range(80):
        levels, roles = rng.sample([*range(7), None], rng.randint(1, 8)), rng.sample([*range(5), None], rng.randint(1, 6))
        names = [*range(rng.choice([1, 2, 9])), None] if w % 2 else [*range(rng.choice([1, 2, 9]))]
        for _ in range(rng.choice([1, 2, 4, 30])):
            name = rng.choice(names)
            rows.add(("s", w, rng.choice(levels), name if name is None else f"c{name}", rng.choice(roles)))
    joint = spark.createDataFrame([(*r, 1) for r in sorted(rows, key=str)], "source string, window_id long, level int, component string, role int, count long")
    got = {(r["window_id"], r["_b"], r["_d"]): r["n"] for r in cube._state_counts(joint, STATES).collect()}
    keys = ["source", "window_id", "_b", "_d"]
    each = joint.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(b).alias("_b"), F.lit(d).alias("_d")) for b, d in STATES]))).select("source", "window_id", "_s.*", *cube.DIMS, "count")
    want = cube.closed(cube.coarsen(each, F.col("_b"), F.col("_d"), keys), keys).groupBy(*keys).agg(F.count("*").alias("n")).collect()
    assert got == {(r["window_id"], r["_b"], r["_d"]): r["n"] for r in want}


def test_crowded_windows_are_replayed_once(spark, monkeypatch):
    made, replay = spark.sparkContext.accumulator(0), behavior._by_replay

    def tallied(rows, n, cap):
        found = replay(rows, n, cap)

        def tally(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return found.mapInArrow(tally, found.schema)

    monkeypatch.setattr(behavior, "_by_replay", tallied)
    e = events(spark, [{"template_str": "abc"[i % 3], "trace_id": i % 4} for i in range(40)])
    docs = fingerprint(e, Config(max_active_traces=3, top_k_size=1, reservoir_size=2), blocks={"behavior"})
    # four traces in turn never find their ring of three again
    assert docs.ngrams.count() == 0 and docs.header.first()["lines"] == 40 and made.value == 0
    docs = fingerprint(e.withColumn("trace_id", (F.col("seq") / 10).cast("long")), Config(max_active_traces=3, top_k_size=1, reservoir_size=2), blocks={"behavior"})
    assert docs.ngrams.count() == 3 and docs.header.first()["lines"] == 40 and made.value == 36


def test_replay_is_that_of_single_rows():
    """Against a plain simulation, with batches of any size, windows that change inside them and events without trace."""
    rng = random.Random(3)
    schema = pa.schema([("source", pa.string()), ("window_id", pa.int64()), ("_ring", pa.int64()), ("ordinal", pa.int64()), ("template_id", pa.string())])
    for _ in range(60):
        rows = [(s, w, rng.choice([None, *range(9)]), i, rng.choice("xyz")) for s in "ab" for w in range(rng.randint(1, 3)) for i in range(rng.randint(1, 40))]
        n, cap, size = rng.choice([2, 3]), rng.randint(1, 6), rng.randint(1, 30)
        want, held = [], {}
        for s, w, ring, at, template in rows:
            rings = held.setdefault((s, w), {})
            if ring is not None and ring not in rings and sum(r is not None for r in rings) >= cap:
                del rings[next(r for r in rings if r is not None)]
            ids = rings.setdefault(ring, [])
            ids.append(template)
            if len(ids) >= n:
                want.append((s, w, ids[-n:], at))
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema) for part in cut]
        assert [tuple(r.values()) for b in behavior._replayed(iter(batches), n, cap) for r in b.to_pylist()] == want
