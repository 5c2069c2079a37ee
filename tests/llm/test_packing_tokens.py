import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fenestra.llm import packing, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(tok, text):
    return np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBé ß.\n\t\x01\x85'’1日İΣ", max_size=60))
def test_cached_encoding_is_the_tokenizers(text):
    enc = tokens.WordEncoder(tokens.tokenizer_path(), cache_words=20)
    assert enc.ids(text) == np.asarray(enc.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_special_tokens_in_texts():
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "<|"):
        assert enc.ids(text) == np.asarray(enc.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@given(st.lists(st.integers(1, 100), max_size=80))
def test_tournament_tree_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    free: list[int] = []
    want = []
    for s in sizes:
        at = next((i for i, f in enumerate(free) if f >= s), len(free))
        if at == len(free):
            free.append(100)
        want.append((at, 100 - free[at]))
        free[at] -= s
    assert packing.first_fit_decreasing(sizes, 100) == want


def check_packing(rows, tok, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids, at = ids_of(tok, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return by_seq


def test_op1_round_trip(spark, tok):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_seq = check_packing(queries.op1_packing(spark, SF).collect(), tok, texts)
    used = [sum(r["length"] for r in m) for m in by_seq.values()]
    assert sum(used) / (2048 * len(used)) > 0.98


def test_edge_texts_and_groups(docs_of, tok):
    rng = random.Random(3)
    texts = {0: None, 1: "", 2: "word " * 30_000, 3: " \n ", 4: "same", 5: "same", **{i: "tok " * rng.randrange(3000) for i in range(6, 60)}}
    pieces = tokens.token_pieces(docs_of(list(texts.items()))).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = packing.pack(pieces, group_pieces=16).collect()
    check_packing(rows, tok, texts)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 2


def test_repeated_rows_and_empty_table(docs_of, spark):
    rows = packing.pack(tokens.token_pieces(docs_of([(1, "a b"), (1, "a b"), (1, "a b")]))).collect()
    assert sorted(r["offset"] for r in rows) == [0, 3, 6]
    full = packing.pack_with_ids(tokens.token_pieces(docs_of([(1, "a b"), (1, "a b"), (2, None)]))).collect()
    assert len(full) == 3 and all(len(r["ids"]) == 4 * r["length"] for r in full)
    assert packing.pack(tokens.token_pieces(docs_of([]))).count() == 0


def test_op3_matches_brute_force(spark, tok):
    lengths = [len(ids_of(tok, r["text"])) - 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = {r["n_tokens"]: r for r in queries.op3_length_histogram(spark, SF).collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == dict(Counter(lengths))
    for k, r in rows.items():
        assert r["docs_at_least"] == sum(n >= k for n in lengths) and r["tokens_at_least"] == sum(n for n in lengths if n >= k)
        assert r["truncated_total"] == sum(min(n, k) for n in lengths) and r["quantile"] == pytest.approx(sum(n <= k for n in lengths) / len(lengths))
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))


def test_histogram_of_nulls_and_nothing(docs_of):
    assert [(r[0], r[1]) for r in tokens.length_histogram(docs_of([(1, None), (2, ""), (2, "")])).collect()] == [(0, 3)]
    assert tokens.context_totals(tokens.length_histogram(docs_of([]))).count() == 0
