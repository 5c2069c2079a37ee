from pyspark.sql import functions as F

from fenestra.config import TERMINATOR
from fenestra.operators import behavior, stats
from fenestra.sources import events as src


def test_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"component":"auth","level":"ERROR","message":"x <*>"}\n{"component":"","level":"odd","message":"y","role":"Terminator"}\n')
    rows = src.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("seq").collect()
    assert [(r["template_str"], r["level"], r["component"], r["role"]) for r in rows] == [("x <*>", 4, "auth", 0), ("y", 6, None, TERMINATOR)]
    (tmp_path / "b.log").write_bytes(b"one\r\ntwo\n\nthree")
    assert [r["line"] for r in src.read_lines(spark, str(tmp_path / "b.log")).collect()] == ["one", "two", "", "three"]


def test_canonical_repairs_and_caps(spark):
    rows = spark.createDataFrame([(0, "t", "c" * 100, ["p" * 64, "ok"])], "seq long, template_str string, component string, params array<string>")
    r = src.canonical(rows, 64).first()
    assert len(r["component"]) == 64 and r["params"][1] == "ok" and len(r["params"][0]) == 64 and r["template_id"].startswith("h:")
    bad = spark.sql("SELECT 0L AS seq, 't' AS template_str, cast(unhex('626164FFFE7AE282') AS string) AS component")
    assert src.canonical(bad).first()["component"] == "bad��z�"


def test_registry_keeps_the_first_spelling(spark):
    known = spark.createDataFrame([("h:1", "old")], "template_id string, template_str string")
    both = src.merge_registries(known, spark.createDataFrame([("h:1", "new"), ("h:2", "two")], "template_id string, template_str string"))
    assert {r[0]: r[1] for r in both.collect()} == {"h:1": "old", "h:2": "two"}
    seen = src.lookup(spark.createDataFrame([("h:2",), ("h:9",)], "template_id string"), both)
    assert {r["template_id"]: r["template_str"] for r in seen.collect()} == {"h:2": "two", "h:9": ""}


def test_scans_are_pruned(spark):
    e = src.driver_events(spark, "/root/testdata/sf0.001")
    plan = stats.window_totals(stats.template_stats(e))._jdf.queryExecution().executedPlan().toString()
    schema = [x for x in plan.split("ReadSchema: ")[1:]]
    assert schema and all("value" not in x.split("\n")[0] for x in schema)


def test_discarded_windows_leave_no_trace(spark):
    e = src.driver_events(spark, "/root/testdata/sf0.001")
    gone = e.select("source", "window_id").where("window_id < 3").distinct()
    kept = src.discard(e, gone)
    assert kept.agg(F.min("window_id")).first()[0] == 3
    assert behavior.ngrams(kept)[0].agg(F.min("window_id")).first()[0] >= 3
