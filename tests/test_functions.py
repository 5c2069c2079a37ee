import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fenestra.config import Config
from fenestra.functions import hll, jcs, stats as S, text as T
from fenestra.operators import churn
from fenestra.operators.stats import divergences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("prev", "cur", "kl", "js"), [({"b": 80, "c": 20}, {"a": 90, "b": 10}, 5.399343617559049, 0.6970227216048024), ({"b": 100}, {"a": 100}, 6.527658316423328, 0.920509557616066)])
def test_divergence_pins(spark, prev, cur, kl, js):
    frame = lambda d: spark.createDataFrame([(0, k, n, 100) for k, n in d.items()], "g int, k string, count long, total long")
    d = divergences(frame(prev), frame(cur), ["g"], ["k"]).first()
    assert d["kl_divergence"] == pytest.approx(kl, abs=1e-9) and d["js_divergence"] == pytest.approx(js, abs=1e-9)


@pytest.mark.parametrize(("counts", "bits"), [([50, 50], 1.0), ([4] * 25, math.log2(25)), ([64] * 4, 2.0), ([7], 0.0)])
def test_entropy(spark, counts, bits):
    frame = spark.createDataFrame([(c, sum(counts)) for c in counts], "c long, n long")
    assert frame.agg(S.entropy_bits(F.col("c"), F.col("n")).alias("x")).first()[0] == pytest.approx(bits, abs=1e-9)


def test_octaves(spark):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 1024, (1 << 63) - 1)], "v long").select(S.octave(F.col("v"))).collect()]
    assert got == [0, 0, 1, 1, 10, 47]


def test_surprise_and_novelty_bands(spark):
    edges = [(1, 1000, 0), (2, 101, 90), (2, 100, 75), (5, 101, 75), (5, 100, 50), (10, 101, 50), (10, 100, 25), (20, 101, 25), (20, 100, 0)]
    rows = spark.createDataFrame(edges, "e long, o long, want int").select(S.surprise_band(F.col("e"), F.col("o")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)
    seen = [(91, 100, 2, 60), (90, 100, 2, 40), (76, 100, 2, 40), (75, 100, 2, 20), (51, 100, 2, 20), (50, 100, 2, 0), (99, 100, 1, 0)]
    rows = spark.createDataFrame(seen, "f long, n long, c long, want int").select(S.novelty_band(F.col("f"), F.col("n"), F.col("c")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_salience_axis_order(spark):
    s, axis = S.salience(F.lit(2), F.lit(3), F.lit(False), F.lit(1), F.lit(10_000), F.lit(90), F.lit(0))
    assert (one(spark, s), one(spark, axis)) == (9000, "terminator")
    s, axis = S.salience(F.lit(6), F.lit(0), F.lit(False), F.lit(1), F.lit(10), F.lit(0), F.lit(0))
    assert (one(spark, s), one(spark, axis)) == (0, None)


def test_cap_text(spark):
    cases = ["", "short", "a" * 63, "a" * 64, "é" * 40, "日本" * 30, "x" * 46 + "é" + "y" * 40, "𝄞" * 40]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.cap_text(F.col("t"), 64).alias("c")).collect()
    for r in rows:
        raw = r["t"].encode()
        if len(raw) < 64:
            assert r["c"] == r["t"]
            continue
        head = raw[:47].decode("utf-8", "ignore")
        assert r["c"] == head + "~" * (48 - len(head.encode())) + hashlib.sha256(raw).hexdigest()[:16]
        assert len(r["c"].encode()) == 64
    assert [r["c"] for r in rows if r["t"] == "a" * 64] == ["a" * 47 + "~ffe054fe7ae0cb6d"]


def test_text_cap_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        Config(max_text_bytes=100)


def test_retention_profile_name():
    c = Config(top_k_size=128, reservoir_size=64, reservoir_error_reserve=16, ngram_size=3, max_param_histograms=4, max_histogram_values=8)
    assert c.retention_profile_name == "salience-1/k128-m64-c0-e16-n3-p4-v8-l64"
    assert Config(ngram_size=9).effective_ngram_size == 3


def test_failure_cues(spark):
    cases = {"request failed": True, "open /var/log/error.log": False, "ERROR: disk": True, "errorless run": False, "all fine": False, "timeout after <*>": True}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.failure_cue(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_tokens_and_times(spark):
    assert one(spark, T.level_of(F.lit("ERROR"))) == 4 and one(spark, T.level_of(F.lit("nope"))) == 6
    assert one(spark, T.row_level_token(F.lit(6))) is None and one(spark, T.level_token(F.lit(6))) == "UNKNOWN"
    assert one(spark, T.role_of(F.lit("Terminator"))) == 3 and one(spark, T.outcome_token(F.lit("Cancelled"))) == "aborted"
    assert one(spark, T.format_rfc3339(T.parse_rfc3339(F.lit("2024-02-29T12:00:01Z")))) == "2024-02-29T12:00:01Z"
    assert one(spark, T.parse_rfc3339(F.lit("2023-02-29T12:00:01Z"))) is None and one(spark, T.parse_rfc3339(F.lit("2023-02-28 12:00:01"))) is None
    assert one(spark, T.shift_label(F.lit("Med"), F.lit("Up"))) == "up_med"


def _hash(data: bytes) -> int:
    h = hll.FNV_OFFSET
    for b in data:
        h = ((h ^ b) * hll.FNV_PRIME) % (1 << 64)
    for k in (hll.MIX_1, hll.MIX_2):
        h ^= h >> 33
        h = (h * k) % (1 << 64)
    return h ^ (h >> 33)


def test_hll_hash_and_accuracy(spark):
    words = ["", "a", "hello", "日本", "x" * 70]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(w,) for w in words], "w string").select(hll.hash64("w")).collect()]
    assert got == [_hash(w.encode()) for w in words]
    for n in (100, 20_000):
        keys = spark.range(n).select(F.lit(0).alias("g"), F.concat(F.lit("key-"), F.col("id")).alias("v"))
        assert hll.cardinality(keys, ["g"], "v").first()["estimate"] == pytest.approx(n, rel=0.03)


def test_presence_churn_is_a_fold_over_every_short_sequence(spark):
    from itertools import product

    rows, want = [], {}
    for n in range(1, 6):
        for k, seq in enumerate(product((1, 2, 3), repeat=n)):
            name = f"{n}-{k}"
            rows += [(name, i, s) for i, s in enumerate(seq)]
            pairs = list(zip(seq, seq[1:], strict=False))
            want[name] = (n, sum(1 not in p and p[0] != p[1] for p in pairs), sum(1 in p for p in pairs), seq[0], seq[-1])
    got = churn.fold(spark.createDataFrame(rows, "name string, at int, s int"), ["name"], "at", "s").select("name", "churn.*").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_canonical_json():
    assert jcs.dumps({"b": 1.0, "a": [1e21, 1e-7, 0.1, 123456789.5, -0.0, 1e20], "é": "\x01\n\""}) == '{"a":[1e+21,1e-7,0.1,123456789.5,0,100000000000000000000],"b":1,"é":"\\u0001\\n\\""}'
    with pytest.raises(ValueError):
        jcs.dumps(float("nan"))
