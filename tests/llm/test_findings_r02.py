import random
from collections import Counter

from fenestra.llm import quality


def prose(rng):
    words = ["the", "of", "and", "water", "stone", "river", "small", "light", "morning", "garden", "walk", "slow"]
    return " ".join(rng.choice(words) for _ in range(60))


def test_quality_filter_shuffles_no_texts(docs_of, spark):
    rng = random.Random(5)
    rows = [(i, prose(rng), rng.choice(["en", "de", None])) for i in range(90)] + [(None, "too short"), (None, prose(rng)), (7, None), (8, "", None), (9, "few words", "xx")]
    docs = docs_of(rows).selectExpr("*", "'s' AS _score", "2 AS _BAND", "map(1, doc_id) AS m")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        left = quality.quality_filter(docs)
        got = left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert left.columns == docs.columns and left.schema["m"].dataType == docs.schema["m"].dataType
    assert Counter((r["doc_id"], r["text"], r["lang"], r["_score"], r["_BAND"], r["label"]) for r in got) == Counter((r[0], r[1], r[2] if len(r) > 2 else "en", "s", 2, "x") for r in rows if r[1] and len(r[1]) > 20)


def test_quality_filter_with_more_languages_than_are_broadcast(docs_of, monkeypatch):
    rng = random.Random(6)
    docs = docs_of([(i, prose(rng), rng.choice(["en", "de", None])) for i in range(60)] + [(70, "too short"), (71, None, None)])
    monkeypatch.setattr(quality, "MAX_BROADCAST_LANGS", 0)
    assert sorted(r["doc_id"] for r in quality.quality_filter(docs).collect()) == list(range(60))
