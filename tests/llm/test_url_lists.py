"""URL rules of any prefix, lists of several cascades, rules that could never apply."""

import random

import pytest
from pyspark.sql import functions as F

from fenestra.llm import urlfilter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: (x[0], x[1], x[3] == "block"), default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def random_case(rng, n_rules):
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "co.uk", "a.co.uk"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/f", "/fr/", "/en/xyz"]
    rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(n_rules)}
    urls = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(['', 'www.', 'B.'])}{rng.choice([*hosts, 'org', 'xcom'])}{rng.choice([*paths, '?q=/en', '#/en', '/en/xyz/1?a'])}" for _ in range(300)]
    return [(h, p, a) for (h, p), a in rules.items()], [*urls, None, "", "://", "http:///en", "no url/en"]


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_rules_of_any_prefix(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)  # 64: several cascades a list
    rules, urls = random_case(random.Random(bits), 30)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_rule_without_closing_slash(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en"), (2, "http://a.com/english"), (3, "http://a.com/e")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, [("a.com", "/en", "block")]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


@pytest.mark.parametrize("rule", [("", "/", "block"), ("A.com", "/", "block"), ("a.com", "en/", "block"), ("a.com", "/?q", "block"), ("a.com", "/", "deny"), (None, "/", "block"), ("a.com/x", "/", "allow")])
def test_rules_that_no_url_meets_are_errors(spark, rule):
    pages = spark.createDataFrame([(1, "http://a.com/en")], "page_id long, url string")
    with pytest.raises(Exception, match="not a rule"):
        urlfilter.judge_urls(pages, [("b.com", "/", "block"), rule])


def test_a_table_of_many_rules(spark):
    rules = spark.range(30_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("action"))
    pages = spark.range(0, 60_000, 3).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), "id", F.lit(".com/"), F.repeat(F.lit("x"), 40)).alias("url"))
    got = urlfilter.judge_urls(pages, rules)
    want = F.when((F.col("page_id") < 30_000) & (F.col("page_id") % 2 == 0), "block").otherwise("allow")
    assert got.where((F.col("verdict") != want) | (F.col("rule").isNull() != (F.col("page_id") >= 30_000))).count() == 0
    assert urlfilter.judge_urls(pages.limit(3), rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 3
