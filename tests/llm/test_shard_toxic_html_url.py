import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from fenestra.llm import htmltext, queries, sharding, toxicity, urlfilter

SF = "/root/testdata/sf0.001"


def test_hilbert_curve_steps_to_neighbours():
    points = sorted(product(range(16), repeat=3), key=sharding.hilbert_index)
    assert sorted(map(sharding.hilbert_index, points)) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


def check_shards(rows, texts, shards=16):
    """Whole groups, slots without gaps, and shards as equal as whole groups allow. Returns the texts that are dealt first."""
    size = lambda t: len((t or "").encode()) + 1
    total = sum(size(t) for _, t in texts)
    assert len(rows) == len(texts) and sum(r["size"] for r in rows) == total
    groups, by, where = {}, {}, {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert len(where) == len(groups) and all(len(s) == 1 for s in where.values())
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    bytes_of = {t: size(t) * len(i) for t, i in groups.items()}
    load = [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]
    # a group larger than a share fills a shard of its own; the others are equal
    over = [b for b in bytes_of.values() if b * shards > total]
    near = sorted(load)[: shards - len(over)]
    share = sum(near) / len(near)
    assert all(abs(x - share) <= max(max(map(size, groups)), total / shards / sharding.GROUP_SHARE) for x in near)
    return {t for t, b in bytes_of.items() if len(groups[t]) > 1 and b * shards * sharding.GROUP_SHARE > total}


def test_op4(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op4_hilbert_sharding(spark, SF).collect()
    dealt = check_shards(rows, docs)
    texts = dict(docs)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in rows)
    order = [r for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if (texts[r["doc_id"]] or "") not in dealt]
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in order) and len(order) > len(rows) / 2


def test_op4_is_native(spark):
    plan = queries.op4_hilbert_sharding(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_of_a_hot_group(docs_of):
    docs = [(i, "the same text") for i in range(200)] + [(300 + i, "x" * i) for i in range(50)] + [(900, None), (901, "")]
    assert check_shards(sharding.shard_by_curve(docs_of(docs)).collect(), docs) == {"the same text"}
    # many groups about as large as a share each, among other texts
    docs = [(100 * g + i, f"group {g}") for g in range(16) for i in range(20)] + [(5000 + i, f"own text {i}") for i in range(400)]
    check_shards(sharding.shard_by_curve(docs_of(docs)).collect(), docs)
    docs = [(None, "same row")] * 300 + [(None, None)] * 40 + [(7, "y")] * 30
    check_shards(sharding.shard_by_curve(docs_of(docs), 4).collect(), docs, 4)
    assert sharding.shard_by_curve(docs_of([])).count() == 0
    twice = sharding.shard_by_curve(docs_of([(1, "a"), (1, "a"), (None, "b")]), 2).collect()
    assert len({(r["shard"], r["slot"]) for r in twice}) == 3


def test_very_long_texts_and_null_metadata(spark):
    rows = [(i, "z" * (200_000 if i == 3 else 2000 + i), None if i % 3 else f"l{i % 5}", None if i % 4 == 0 else f"s{i}") for i in range(120)]
    got = sharding.shard_by_curve(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    check_shards(got, [(r[0], r[1]) for r in rows], 4)


def test_buckets_are_ranges_of_values(spark):
    rows = spark.createDataFrame([(f"v{i % 40:02d}", 1 if i % 40 else 30) for i in range(4000)], "v string, w long")
    (edges,) = sharding.quantile_edges(rows, [F.col("v")], F.col("w"), 7)
    weight = {}
    for i in range(4000):
        weight[f"v{i % 40:02d}"] = weight.get(f"v{i % 40:02d}", 0) + (1 if i % 40 else 30)
    total, before, want = sum(weight.values()), 0, {}
    for v in sorted(weight):
        want.setdefault(int((before + weight[v] / 2) * 16 / total), v)
        before += weight[v]
    assert edges == sorted(want.items())
    got = {r["v"]: r["b"] for r in rows.select("v", sharding._bucket(F.col("v"), edges).alias("b")).distinct().collect()}
    assert [got[v] for v in sorted(got)] == sorted(got.values()) and len(set(got.values())) == len(edges)


def test_written_shards(docs_of, spark, tmp_path):
    sharding.write_shards(docs_of([(i, f"text {i}") for i in range(50)]), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_written_shards_with_clashing_columns_and_repeated_rows(docs_of, spark, tmp_path):
    docs = docs_of([(i // 2, f"text {i // 4}") for i in range(40)] + [(None, None), (None, None)]).selectExpr("*", "'a' AS shard", "2 AS slot", "'b' AS hilbert", "3 AS own_id")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "_shard"} and back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == 42


def test_files_of_shards_prune(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    sharding.write_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "out"), 16)
    files = glob.glob(str(tmp_path / "out/shard=*/*.parquet"))
    span = lambda f, c: (lambda s: (s.min, s.max))(pq.read_metadata(f).row_group(0).column(pq.read_schema(f).names.index(c)).statistics)
    values = {c: {x for f in files for x in span(f, c)} for c in ("lang", "source")}
    for c, own in values.items():
        read = [sum(lo <= v <= hi for lo, hi in (span(f, c) for f in files)) / len(files) for v in own]
        assert sum(read) / len(read) < 0.75, (c, read)  # an equality filter reads a part of the files


def test_op5_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(marks[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    hit, miss, false = (sum(x == y for x in held) for y in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + miss) > 0.9 and hit / (hit + false) > 0.9


def test_toxicity_edges(docs_of, spark):
    marks = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([(1, "x"), (2, "y")]), marks)
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of([(1, None), (2, ""), (3, "you idiot, you moron"), (4, "a calm walk"), (4, "a calm walk")]), model).collect()}
    assert rows[1] == rows[2] < 0.3 and rows[3] >= 0.3 and rows[4] < 0.3
    assert toxicity.score(docs_of([]), model).count() == 0


def test_label_model_orders_voters():
    import numpy as np

    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.2).astype(int)
    noisy = lambda p: np.where(rng.random(2000) < p, y, 1 - y)
    good, copy, poor = noisy(0.95), None, noisy(0.6)
    copy = good.copy()
    post, weight = toxicity.label_model(np.stack([good, copy, poor], axis=1), noisy(0.9))
    assert ((post > 0.5) == y).mean() > 0.93 and weight[0] < 0.8 < weight[2] + 0.3


PAGE = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1><p>Welcome to a long header text that goes on for many words</p></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies here to make everything better for you and for all of us</div>
<!-- c --><article><h1>Title &amp; more</h1><p>First  para&nbsp;with
 words &lt;b&gt;.<br>Next <a href="x">link</a> here.<div class="ad">Buy now this thing and that thing</div><p>Second.<form><p>Your name</p><input></form><p>Third one.</article>
<aside><p>Side text that is long enough to look like an article if only words were counted</p></aside><section class="comments"><p>A reader wrote a long comment on this page and it goes on and on and on</p></section><footer>&copy; me</footer>"""


def test_html_blocks():
    assert htmltext.extract(PAGE) == "Title & more\n\nFirst para with words <b>. Next link here.\n\nSecond.\n\nThird one."


def test_html_hints():
    page = """<body><div class="page has-sidebar"><main><article class="post"><p>One good line.</p><p class="advert">Buy.</p><p class="lead">Two.</p>
    <article class="comment"><p>I disagree with all of this.</p></article><h2 class="related-title">More</h2><p>Three.</p></article>
    <ol class="commentlist"><li>And I agree with it entirely, my friends.</li></ol></main><div id="userComments"><p>Me too.</p></div></div>"""
    assert htmltext.extract(page) == "One good line.\n\nTwo.\n\nThree."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='", "</p>", "<!--", "<script>x", "&am", "<table><tr><td>"])
def test_html_broken_pages(page):
    assert isinstance(htmltext.extract(page), str)


def test_html_cut_anywhere():
    for k in range(0, len(PAGE), 7):
        htmltext.extract(PAGE[:k])


def test_tree_fits_its_table():
    right = sum(htmltext.classify(r[:-1]) == r[-1] for r in htmltext.TABLE)
    assert right >= 0.97 * len(htmltext.TABLE)


def test_op7(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        parts = re.split(r"</?p>|</?h1>|<br>", inner[1] if inner else "")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_op9_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({urlfilter.JUDGE_SQL})").fetchall()
    got = [tuple(r) for r in queries.op9_bloom_cascade(spark, SF).select(*cols).collect()]
    assert sorted(got) == sorted(want)


def test_url_rules(spark):
    urls = {
        "http://a.com/x": ("com/", "allow"), "https://EXAMPLE.com/en/1": ("example.com/en/", "block"), "https://www.example.com/en/1?q=/x": ("www.example.com/en/", "allow"), "http://b.net/es/": ("net/es/", "block"),
        "http://b.net/es": (None, "allow"), "http://b.net": (None, "allow"), "http://a.com": (None, "allow"), "http://xcom/en/": (None, "allow"), "http://com/": ("com/", "allow"), "no url": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
        "ftp://c.example.com:80/en/": (None, "allow"), "http://b.net/fr//es/": ("net/fr/", "block"), "x://y.net?a=/es/": (None, "allow"),
    }
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS key")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(frame).collect()}
    assert got == dict(enumerate(urls.values()))
    assert urlfilter.judge_urls(frame.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    cascade = urlfilter.Cascade(universe, listed)
    assert universe.where(cascade.contains(F.col("key"))).exceptAll(listed).count() == 0
    assert listed.where(~cascade.contains(F.col("key"))).count() == 0 and len(cascade.levels) > 1
