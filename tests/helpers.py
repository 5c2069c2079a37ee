"""Small event frames for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenestra.sources.events import canonical

SCHEMA = "window_id long, seq long, template_str string, level int, role int, component string, trace_id long, is_span boolean, span_id long, parent_span_id long, params array<string>"


def events(spark, rows: list[dict]) -> DataFrame:
    """Events of dicts; seq defaults to the place in the list."""
    full = [{"window_id": 0, "seq": i, "level": 2, "role": 0, "component": None, "trace_id": None, "is_span": False, "span_id": None, "parent_span_id": None, "params": None} | r for i, r in enumerate(rows)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)
    return canonical(frame.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("window_id") * 60 + F.col("seq") % 60)))


def lines(text: str, **kw) -> list[dict]:
    return [{"template_str": t} | kw for t in text.split()]
