"""corpus_pipeline.run against a version that counts, compares and searches everything by itself, on the small fixture."""

import math
from collections import Counter, defaultdict

import corpus_pipeline
from fenestra.llm import decontam, linededup, quality, tokens
from test_alignment import brute as brute_lines
from test_dedup import shingles

SF = "/root/testdata/sf0.001"
N = quality.ORDER


class Model:
    """Modified Kneser-Ney over character n-grams of words, in dictionaries."""

    def __init__(self, texts):
        count = [Counter() for _ in range(N + 1)]
        for lang, text in texts:
            for w in (text or "").split():
                padded = quality.PAD * (N - 1) + w + quality.END
                count[N].update((lang, padded[i : i + N]) for i in range(len(w) + 1))
        for k in range(N - 1, 0, -1):
            count[k].update((lang, g[1:]) for lang, g in count[k + 1])
        chars = len({g[-1] for _, g in count[N]}) + 1
        self.floor, self.logp, self.back = -math.log2(chars), [{} for _ in range(N + 1)], [{} for _ in range(N + 1)]
        for k in range(1, N + 1):
            of = Counter(count[k].values())
            d = {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.5}
            if all(of[i] for i in (1, 2, 3, 4)):
                y = of[1] / (of[1] + 2 * of[2])
                found = {1: 1 - 2 * y * of[2] / of[1], 2: 2 - 3 * y * of[3] / of[2], 3: 3 - 4 * y * of[4] / of[3]}
                d |= {i: x for i, x in found.items() if 0 <= x <= i}
            total, mass = Counter(), Counter()
            for (lang, g), c in count[k].items():
                total[lang, g[:-1]] += c
                mass[lang, g[:-1]] += d[min(c, 3)]
            for (lang, g), c in count[k].items():
                ctx = (lang, g[:-1])
                gamma = max(mass[ctx] / total[ctx], 1e-9)
                lower = 2.0 ** self.logp[k - 1][lang, g[1:]] if k > 1 else 1 / chars
                self.logp[k][lang, g] = math.log2(max(c - d[min(c, 3)], 0) / total[ctx] + gamma * lower)
                self.back[k][ctx] = math.log2(gamma)

    def bits(self, word, lang):
        padded, out = quality.PAD * (N - 1) + word + quality.END, 0.0
        for i in range(len(word) + 1):
            gram = padded[i : i + N]
            for k in range(N, 0, -1):
                g = (lang, gram[N - k :])
                if g in self.logp[k]:
                    out += self.logp[k][g]
                    break
                out += self.back[k].get((lang, gram[N - k : -1]), 0.0)
            else:
                out += self.floor
        return -out


def verdicts(docs):
    """doc_id -> (bits per word or None, kept)."""
    model, bits, memo = Model([(lang or "", t) for _, t, lang in docs]), {}, {}
    for i, text, lang in docs:
        words = (text or "").split()
        own = [memo.setdefault((w, lang), model.bits(w, lang or "")) for w in words]
        bits[i] = sum(own) / len(words) if words else None
    limit = {}
    for lang in {x or "" for _, _, x in docs}:
        b = sorted(round(bits[i], 3) for i, _, x in docs if (x or "") == lang and bits[i] is not None)
        q1, q2, q3 = (b[math.ceil(p * len(b)) - 1] for p in (0.25, 0.5, 0.75)) if b else (0, 0, 0)
        limit[lang] = (min(q1 - quality.LOWER * (q3 - q1), q2 - quality.LEAST_BITS), max(q3 + quality.UPPER * (q3 - q1), q2 + quality.LEAST_BITS))
    out = {}
    for i, text, lang in docs:
        words = (text or "").split()
        windows = defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        again = {k + x for at in windows.values() if len(at) > 1 for k in at for x in range(8)}
        fine = len(words) >= 20 and 100 * len(again) <= 30 * len(words)
        low, high = limit[lang or ""]
        out[i] = (bits[i], fine and low <= bits[i] <= high)
    return out


def leaks(texts, items):
    """Documents that hold an item: every item is scored in every passage."""
    bags = {n: Counter(decontam.terms(t)) for n, t in items}
    bags = {n: b for n, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    size = {n: sum(b.values()) for n, b in bags.items()}
    mean, longest = sum(size.values()) / len(size), max(size.values())
    weight = {}
    for n, b in bags.items():
        own = {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[n] / mean)) for w, tf in b.items()}
        weight[n] = {w: x / sum(own.values()) for w, x in own.items()}
    out = set()
    for i, text in texts.items():
        words = decontam.terms(text)
        five = {k: {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} for k in range(1, 6)}
        for start in range(0, max(1, len(words)), longest):
            held = set(words[start : start + 2 * longest])
            for n, t in items:
                if n in weight and sum(x for w, x in weight[n].items() if w in held) >= 0.6 - 1e-9:
                    parts = decontam.question_answer(t)
                    cover = [len(p_ & five[k]) / len(p_) for p in parts if p for k in [min(5, len(p))] for p_ in [{tuple(p[j : j + k]) for j in range(len(p) - k + 1)}]]
                    if all(c >= 0.5 for c in cover):
                        out.add(i)
    return out


def test_quality_equals_a_model_in_dictionaries(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = verdicts(docs)
    got = {r["doc_id"]: r for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for i, (bits, kept) in want.items():
        assert (bits is None) == (got[i]["perplexity"] is None) and (bits is None or abs(math.log2(got[i]["perplexity"]) - bits) < 1e-3)
    assert {i for i in got if got[i]["kept"]} == {i for i, (_, kept) in want.items() if kept}


def test_run_equals_all_pairs(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    judged = verdicts(docs)
    texts = {i: t for i, t, _ in docs if judged[i][1]}
    texts = {i: "\n".join(x) for i, x in brute_lines(texts, linededup.MIN_WORDS).items() if x}
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    texts = {i: t for i, t in texts.items() if find(i) == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = leaks(texts, items)
    assert gone
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    want = {i: enc.ids(t) + (1).to_bytes(4, "little") for i, t in texts.items() if i not in gone}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items()} == want


def test_stages_judge_rows_without_ids(docs_of, spark):
    base = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:-1], "y"]), " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (None, near), (None, other), (None, other), (7, " ".join(f"a{i}" for i in range(60))), (7, " ".join(f"b{i}" for i in range(60))), (7, near), (None, None), (5, None)]
    docs = docs_of(rows).selectExpr("*", "'z' AS _doc_id", "1 AS shard")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])[:2]) for r in kept.collect())
    assert got == [("3", "w0"), ("5", "No"), ("7", "a0"), ("7", "b0"), ("None", "No"), ("None", "v0")]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    leaky = docs_of([(None, f"x {item} y"), (None, other), (4, item), (9, text), (9, item)])
    left = corpus_pipeline.decontamination(spark, leaky, SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("None", other), ("9", text)]) and left.columns == leaky.columns
    lines = corpus_pipeline.line_dedup(spark, docs_of([(1, f"{text}\none"), (None, f"{text}\ntwo"), (None, text)]), SF)
    assert sorted((str(r["doc_id"]), r["text"][-3:]) for r in lines.collect()) == [("1", "one"), ("None", "two")]
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
