import random

import pytest
from hypothesis import given, strategies as st

from fenestra.llm import linededup, neardup, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """doc_id -> (set size, component), by comparing all pairs."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(rows, texts):
    want = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op2_matches_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op2_minhash_odd_sketch(spark, SF).collect(), texts)


def test_near_copies_of_many_degrees(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 24)  # several blocks in the large group
    rng = random.Random(7)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        texts[1000 - i] = " ".join(words)
    texts |= {1: None, 2: "", 3: " \t\n", 4: "One two", 5: "one TWO", 6: "one two three", 7: "É x", 8: "é x", 9: " ".join(base).upper()}
    texts |= {20 + i: "same text in many rows of one group" for i in range(40)}
    check(neardup.near_duplicates(docs_of(list(texts.items()))).collect(), texts)


def test_near_duplicates_edges(docs_of, spark):
    assert neardup.near_duplicates(docs_of([])).count() == 0
    rows = neardup.near_duplicates(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c")])).collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in sorted(rows, key=lambda r: r["doc_id"] or 9)] == [(1, 1, True), (1, 1, True), (None, None, True)]
    kept = neardup.near_duplicate_filter(docs_of([(1, "a b c"), (2, "a b c"), (3, "d"), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and "label" in kept.columns


def test_odd_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for shared in (900, 970):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        sketch = [neardup.odd_sketch(neardup.minhash(x)) for x in (a, b)]
        differ = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert neardup.sketch_similarity(differ) == pytest.approx(shared / (2000 - shared), abs=0.12)
        assert differ <= neardup.sketch_limit(0.85) or shared == 900


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_is_an_alignment(a, b):
    pairs = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)
    common = set(a) & set(b)
    assert bool(pairs) == bool(common)


def line(rng, n=12):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def brute_lines(texts, min_words):
    """Lines that an earlier document owns, aligned with that owner by longest common subsequence; runs long enough go."""
    out, owner = {}, {}
    for i in sorted(texts):
        for x in (texts[i] or "").split("\n"):
            if x.strip():
                owner.setdefault(x.strip(), i)
    for i in sorted(texts):
        mine = (texts[i] or "").split("\n")
        aligned = {j for j, x in enumerate(mine) if x.strip() and owner[x.strip()] < i}
        out[i] = linededup.delete_blocks(texts[i] or "", dict.fromkeys(aligned, 0), min_words)[0] if aligned else texts[i]
    return out


def test_line_dedup_matches_ownership_where_order_agrees(docs_of):
    rng = random.Random(2)
    shared = [line(rng) for _ in range(6)]
    texts = {i: "\n".join([line(rng), *shared[i % 3 : i % 3 + 3], line(rng), "short", "short"]) for i in range(30)}
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs_of(list(texts.items()))).collect()}
    want = brute_lines(texts, linededup.MIN_WORDS)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[0]["deleted_lines"] == 0 and got[29]["deleted_lines"] == 3 and got[29]["earlier"]


def test_crossed_blocks_keep_one_side(docs_of):
    rng = random.Random(4)
    a, b, c = (line(rng, 20) for _ in range(3))
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs_of([(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n{a}\n{b}")])).collect()}
    assert got[2]["text"] == c and got[2]["deleted_lines"] == 2  # an alignment can't cross: the longer block goes


def test_line_dedup_edges(docs_of):
    long = "word " * 20
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, f"{long}\n\n{long} x"), (6, long), (6, long), (None, long), (7, "short line"), (8, "short line")]
    done = linededup.line_dedup(docs_of(rows))
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got[1] is None and got[2] == "" and got[3] == "\n\n" and got[4] == long and got[6] == "" and got[None] == long and got[8] == "short line"
    assert got[5] == f"\n{long} x" and done.count() == len(rows) and {"label", "slice", "_id"} <= set(done.columns)
    kept = linededup.line_dedup_filter(docs_of(rows))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert linededup.line_dedup(docs_of([])).count() == 0
