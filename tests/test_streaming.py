import json

from helpers import events, lines
from pyspark.sql import functions as F

from fenestra.config import Config
from fenestra.plans.documents import fingerprint, to_json
from fenestra.streaming.live import LiveFingerprints, windowed_counts


def test_live_documents_equal_batch_ones(spark, tmp_path):
    rows = lines("a b a c", window_id=0) + lines("a b d", window_id=1) + lines("e a", window_id=2)
    batch = events(spark, rows).withColumn("window_id", F.expr("unix_seconds(ts) div 60"))
    cols = ["seq", "ts", "template_str", "level", "role", "component"]
    for k, part in enumerate((rows[:4], rows[4:7], rows[7:])):
        ids = [r["template_str"] for r in part]
        assert ids
        batch.where(F.col("seq").between(*[(0, 3), (4, 6), (7, 9)][k])).select(*cols).write.parquet(str(tmp_path / "in" / str(k)))
    schema = batch.select(*cols).schema
    live = LiveFingerprints(spark, str(tmp_path / "state"), 60, 0, Config(top_k_size=4))
    for k in range(3):
        live.batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / str(k))), k)
    before = live.documents().count()
    live.batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / "2")), 2)
    assert live.documents().count() == before < 3
    live.flush()
    got = {r["window_id"]: json.loads(r["json"]) for r in live.documents().collect()}
    want = {r["window_id"]: json.loads(r["json"]) for r in to_json(fingerprint(batch, Config(top_k_size=4))).collect()}
    assert set(got) == set(want)
    for w in want:
        assert got[w]["stats"] == want[w]["stats"] and got[w]["window"] == want[w]["window"]
    assert live.stability().count() == 2


def test_structured_stream(spark, tmp_path):
    e = events(spark, lines("a b a", window_id=0) + lines("a", window_id=5)).select("source", "ts", "template_id", "seq", "template_str")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "1 minute", "0 seconds").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(count) FROM counts").first()[0] == 3
    live = LiveFingerprints(spark, str(tmp_path / "state"), 60, 0, Config(top_k_size=4))
    live.start(stream).awaitTermination(240)
    live.flush()
    assert live.documents().count() == 2
