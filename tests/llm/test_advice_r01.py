
import random
from collections import Counter

from fenestra.llm import decontam, htmltext, linededup, neardup, quality


def test_every_ngram_of_every_language_keeps_its_count(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(chr(rng.randrange(97, 123)) for _ in range(9)) for _ in range(120)), "en" if i % 2 else "de") for i in range(60)]
    want = Counter()
    for _, text, lang in rows:
        for w in text.split():
            padded = quality.PAD * (quality.ORDER - 1) + w + quality.END
            want.update((quality._lang_number(lang), padded[k : k + quality.ORDER]) for k in range(len(w) + 1))
    got = {(r["lang_no"], r["gram"]): r["n"] for r in quality.count_ngrams(docs_of(rows)).collect()}
    assert len(want) > 20_000 and got == dict(want)
    lm = quality.fit_model(docs_of(rows))
    assert len(lm.slots[quality.ORDER - 1]) == len(want)


def test_both_bands_reject_planted_texts(docs_of):
    rng = random.Random(6)
    make = lambda n: ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    words = make(800)
    plain = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(400)]
    common = words[:12]
    for i in range(0, 400, 2):  # common words make up a fifth of half the texts, as stop words do
        w = plain[i][1].split()
        plain[i] = (i, " ".join(rng.choice(common) if rng.random() < 0.2 else x for x in w))
    low = [(1000 + i, " ".join(rng.choice(common) for _ in range(80))) for i in range(5)]
    high = [(2000 + i, " ".join(x if rng.random() < 0.5 else "".join(rng.choice("qxzwvjy") for _ in range(6)) for x in rng.choices(words, k=80))) for i in range(5)]
    got = {r["doc_id"]: r for r in quality.quality(docs_of(plain + low + high)).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert not any(got[i]["kept"] for i, _ in low + high)
    lost = [i for i, _ in plain if not got[i]["kept"]]
    assert len(lost) <= 8, lost


def test_pipeline_links_from_similarity_080(docs_of):
    words = [f"w{i}" for i in range(150)]
    near = list(words)
    for k in (20, 60, 100):  # 15 of 146 shingles differ: similarity 131 / 161 = 0.81
        near[k] = f"x{k}"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "something else altogether, and long enough")]
    assert sorted(r["doc_id"] for r in neardup.near_duplicate_filter(docs_of(rows)).collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in neardup.near_duplicate_filter(docs_of(rows), 0.85).collect()) == [1, 2, 3]
    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 1e-7


def test_line_dedup_finds_blocks_behind_an_owner_in_another_order(docs_of):
    rng = random.Random(8)
    x, y, z = (" ".join(f"w{rng.randrange(9999)}" for _ in range(55)) for _ in range(3))
    rows = [(1, f"{z}\n{y}\n{x}"), (2, f"{x}\n{y}\n\n{z}"), *[(i, f"own {i}\n{x}\n{y}\n{z}") for i in range(3, 7)]]
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert [got[i]["text"] for i in range(3, 7)] == [f"own {i}" for i in range(3, 7)]
    assert got[1]["deleted_lines"] == 0 and got[2]["deleted_lines"] == 1 and 2 in got[3]["earlier"]
    # pairs of a and b, c and d lie in document 1, but only document 2 has the whole run
    a, b, c, d = (" ".join(f"v{rng.randrange(9999)}" for _ in range(20)) for _ in range(4))
    rows = [(1, f"{c}\n{d}\n{a}\n{b}"), (2, f"{a}\n{b}\n{c}\n{d}"), (3, f"{a}\n{b}\n{c}\n{d}"), (4, f"{a}\n{b}"), (4, f"no\n{c}\nx")]
    got = linededup.line_dedup(docs_of(rows)).collect()
    assert [r["text"] for r in got if r["doc_id"] == 3] == [""]
    assert sorted(r["text"] for r in got if r["doc_id"] == 4) == ["", "no\nx"]


def test_html_class_of_one_block_does_not_drop_the_article():
    long = "This paragraph of the article is long enough to be told from menus, notes and other things on the page by its words."
    nav = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul>"
    want = "\n\n".join([long + " 1", long + " 2", long + " 3"])
    page = f"<body>{nav}<div><h1 class='post-title'>Title</h1><p>{long} 1</p><p>{long} 2</p><p>{long} 3</p></div></body>"
    assert htmltext.extract(page) == "Title\n\n" + want
    page = f"<body>{nav}<div><p>{long} 1</p><p class='text-justify'>{long} 2</p><p>{long} 3</p></div></body>"
    assert htmltext.extract(page) == want
    small = f"<body><div class='content'><p>A few words.</p></div><div><p>{long} 1</p><p>{long} 2</p><p>{long} 3</p></div></body>"
    assert htmltext.extract(small).endswith(want)
    held = f"<body><article><p>{long} 1</p><p>{long} 2</p><p>{long} 3</p></article><div><p>{long} 4</p></div></body>"
    assert htmltext.extract(held) == want


def test_quality_filter_judges_rows_not_ids(docs_of):
    rng = random.Random(13)
    words = ["the", "of", "and", "water", "stone", "river", "small", "light", "morning", "garden", "walk", "slow"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(60))
    clean = [(None, prose()), (None, prose()), (7, prose())]
    rows = [(100 + i, prose()) for i in range(50)] + clean + [(None, "too short"), (7, "also short"), (None, None), (7, "")]
    left = quality.quality_filter(docs_of(rows))
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert got == Counter((i, t) for i, t in rows if t and len(t) > 20)
    assert {"label", "slice", "_id"} <= set(left.columns)


def test_scores_do_not_depend_on_the_items_of_a_block(docs_of, spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(15)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(5000)}" for _ in range(10 + i))) for i in range(21)]
    rows = []
    for i, text in items:
        words = text.split()
        rows.append((i, " ".join(["x"] * 7 + words[: int(len(words) * (0.55 + 0.02 * i))] + ["y"] * 90)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [
        {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontam.contamination(docs_of(rows), bench, items=n).collect()}
        for n in (1024, 5, 1)
    ]
    assert got[0] and got[0] == got[1] == got[2]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_segments_without_anchors_align_by_a_longest_common_subsequence():
    assert len(linededup.patience(list("qpprr"), list("pprrqq"))) == 4
    rng = random.Random(12)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(24))] for _ in range(2))
        pairs = linededup.longest_common(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    a, b = ([rng.randrange(40) for _ in range(3000)] for _ in range(2))
    assert len(linededup.longest_common(a, b)) > 500
