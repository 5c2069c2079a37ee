"""Live state that survives reruns and stays small."""

import json

import pytest
from helpers import events, lines
from pyspark.sql import functions as F

from fenestra.config import Config
from fenestra.plans.documents import fingerprint, to_json
from fenestra.streaming import live as streaming
from fenestra.streaming.live import LiveFingerprints

COLS = ["seq", "ts", "template_str", "level", "role", "component"]
C = Config(top_k_size=4)
BLOCKS = {"stability"}


def stream_of(spark, rows):
    return events(spark, rows).withColumn("window_id", F.expr("unix_seconds(ts) div 60")).select(*COLS)


def got(live):
    return {r["window_id"]: json.loads(r["json"]) for r in live.documents().collect()}


def want(spark, rows):
    e = events(spark, rows).withColumn("window_id", F.expr("unix_seconds(ts) div 60"))
    return {r["window_id"]: json.loads(r["json"]) for r in to_json(fingerprint(e, C, blocks=BLOCKS)).collect()}


def test_two_flushes_and_a_batch_between(spark, tmp_path):
    rows = lines("a b a", window_id=0) + lines("a c", window_id=1) + lines("d a", window_id=2)
    live = LiveFingerprints(spark, str(tmp_path / "s"), 60, 0, C, BLOCKS)
    e = stream_of(spark, rows)
    live.batch(e.where("seq < 5"), 0)
    live.flush()
    assert len(got(live)) == 2
    live.batch(e.where("seq >= 5"), 1)
    live.flush()
    assert got(live) == want(spark, rows)  # stability across steps too
    assert live.registry().count() == 4 and live.stability().count() == 2


@pytest.mark.parametrize("lost", ["registry", "marks"])
def test_a_step_that_broke_off_runs_again(spark, tmp_path, monkeypatch, lost):
    rows = lines("a b a", window_id=0) + lines("a c", window_id=1) + lines("d a", window_id=2)
    live = LiveFingerprints(spark, str(tmp_path / "s"), 60, 0, C, BLOCKS)
    e = stream_of(spark, rows)
    live.batch(e.where("seq < 4"), 0)
    write = streaming.LiveFingerprints._write

    def broken(self, frame, name, step):
        if name == lost and step == 1:
            raise OSError("executor gone")
        return write(self, frame, name, step)

    monkeypatch.setattr(streaming.LiveFingerprints, "_write", broken)
    with pytest.raises(OSError):
        live.batch(e.where("seq >= 4"), 1)
    monkeypatch.undo()
    live.batch(e.where("seq >= 4"), 1)
    live.batch(e.where("seq >= 4"), 1)  # delivered once more after it was finished
    live.flush()
    assert got(live) == want(spark, rows) and live.registry().count() == 4


def test_state_holds_open_windows_alone(spark, tmp_path):
    live = LiveFingerprints(spark, str(tmp_path / "s"), 60, 0, C, BLOCKS)
    for k in range(4):
        live.batch(stream_of(spark, lines("a b", window_id=k)), k)
        held = spark.read.parquet(str(tmp_path / "s" / "open")).count() + spark.read.parquet(str(tmp_path / "s" / "input")).count()
        assert held == 2
    assert live.documents().count() == 3
