import math
import random
from collections import Counter

import pytest

from fenestra.llm import decontam, quality, queries

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words_of(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_op10_counts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_kneser_ney(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_kneser_ney_sums_to_one():
    """Over the characters that follow a context, known or not, the interpolated probabilities leave the unseen ones' share."""
    import numpy as np

    words = Counter({"the": 50, "then": 20, "than": 9, "hat": 7, "eat": 3, "ten": 1})
    batch = next(quality._ngram_rows({"en": Counter({w.encode(): n for w, n in words.items()})}))
    grams = batch.column("gram").to_pylist()
    lm = quality.KneserNey.fit(grams, batch.column("lang_no").to_numpy(), batch.column("n").to_numpy())
    chars = sorted({g[-1] for g in grams})
    no = quality._lang_number("en")
    one = lambda ctx, c: 2 ** _bits(lm, ctx + c, no)
    for ctx in ("\x02\x02\x02\x02", "\x02\x02\x02t", "\x02\x02th", "\x02\x02zz"):
        assert sum(one(ctx, c) for c in chars) == pytest.approx(1 - one(ctx, "☃"), abs=1e-5)
    assert lm.bits(["the"], no)[0] > lm.bits(["qzx"], no)[0] and np.isfinite(lm.bits(["\U0001f600"], no)[0])


def _bits(lm, gram, no):
    import numpy as np

    cps, score = np.array([[ord(c) for c in gram]], dtype=np.uint32), 0.0
    for k in range(quality.ORDER, 0, -1):
        s = quality._slots(cps[:, quality.ORDER - k :], no)[0]
        at = np.searchsorted(lm.slots[k - 1], s)
        if at < len(lm.slots[k - 1]) and lm.slots[k - 1][at] == s:
            return score + float(lm.logp[k - 1][at])
        x = quality._slots(cps[:, quality.ORDER - k : -1], no)[0]
        at = np.searchsorted(lm.contexts[k - 1], x)
        if at < len(lm.contexts[k - 1]) and lm.contexts[k - 1][at] == x:
            score += float(lm.backoff[k - 1][at])
    return score + lm.floor


def test_perplexity_rejects_noise_and_keeps_prose(docs_of):
    rng = random.Random(1)
    prose = ["the", "of", "and", "water", "stone", "river", "small", "light", "morning", "garden", "walk", "slow"]
    rows = [(i, " ".join(rng.choice(prose) for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(12)) for _ in range(60))) for i in range(3)]
    rows += [(2000, None), (2001, ""), (2002, "few words"), (2003, "again and again we say the same words " * 20)]
    got = {r["doc_id"]: r for r in quality.quality(docs_of(rows)).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(3))
    assert not any(got[i]["kept"] for i in (2000, 2001, 2002, 2003)) and got[2000]["n_words"] == 0
    left = quality.quality_filter(docs_of(rows))
    assert left.count() == 300 and "label" in left.columns


def test_quality_edges(docs_of):
    assert quality.quality(docs_of([])).count() == 0
    rows = quality.quality(docs_of([(1, "a b", None), (1, "a b", None), (2, "\U0001f600 " * 25, "xx")])).collect()
    assert len(rows) == 3 and math.isfinite(rows[0]["perplexity"] or 1.0)


def test_op8_matches_brute_force(spark):
    docs = [(r["doc_id"], decontam.terms(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for item, text in items:
        q, a = decontam.question_answer(text)
        for doc, words in docs:
            known = {}
            if decontam.coverage(q, words, known) >= 0.99 and decontam.coverage(a, words, known) >= 0.99:
                want.add((doc, item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2 and want


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    index = decontam.Index.build([(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(37)])
    for _ in range(200):
        query = sorted({index.vocabulary[t] for t in rng.choices(vocabulary, k=20) if t in index.vocabulary})
        scores = Counter()
        for t in query:
            for own in index.postings[t].values():
                for d, x in own:
                    scores[d] += x
        blocks = list(range(index.maxima.shape[1]))
        got = dict(index.search(query, blocks, 0.4))
        assert set(got) == {d for d, s in scores.items() if s >= 0.4}
        assert all(got[d] == pytest.approx(scores[d]) for d in got)


def test_decontamination_edges(docs_of, spark):
    rng = random.Random(3)
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(30))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "?"), (5, "Where is it? " + item[:40]), (6, item)], "item_id long, text string").selectExpr("*", "1 AS score")
    rows = [(10, "x " * 3000 + item.upper() + " y" * 3000), (11, None), (12, ""), (13, "nothing here"), (None, item), (14, item), (14, item)]
    got = decontam.contamination(docs_of(rows), bench, items=2).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 1), (10, 6), (14, 1), (14, 6)}
    assert sorted(r["doc_id"] or 0 for r in decontam.decontaminate(docs_of(rows), bench).collect()) == [0, 11, 12, 13]
    assert decontam.contamination(docs_of([]), bench).count() == 0 and decontam.contamination(docs_of(rows), bench.limit(0)).count() == 0
