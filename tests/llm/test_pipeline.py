import corpus_pipeline
from fenestra.llm import decontam, linededup, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and ids(out) <= ids(docs)
        if k == 0:
            assert ids(out) == {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
        elif k == 1:
            assert {r["doc_id"]: r["text"] for r in out.collect()}.items() <= {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs).collect()}.items()
        elif k == 2:
            assert ids(out) == {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
        else:
            found = decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids(out) == ids(docs) - {r["doc_id"] for r in found.collect()}
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(packed) == ids(docs)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
