"""URL rules by a cascade of Bloom filters: exact membership over a known universe of keys, without joins.

Level 1 encodes the listed keys. The keys of the universe that it takes for listed ones, though they aren't, are encoded
by level 2; the listed keys that level 2 takes for those by level 3; and so on, until a level makes no mistake. A key is
listed iff the first level that denies it is an even one. The universe is complete: every key that any row of the corpus
asks for. Level 1 is sized so that it lets about as many keys through as are listed, so all levels together hold a few
bytes a listed key, whatever the universe's size. Longer lists are dealt by a hash of the key to cascades of ``MAX_BITS``
bits a level at most; a list's filters are part of the plan and so in every executor's memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

#: Bits of one level of one cascade at most, about.
MAX_BITS = 1 << 22
#: Between a key's host and path: a character that neither has.
SEP = "\x1f"

#: Rules (host, path) of the query, with their actions. Fixed values.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; empty where there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, labels, chars, action) of rules (host, path, action). A rule that no URL could meet is an error, not ignored."""
    host, path, action = (F.col(c) for c in ("host", "path", "action"))
    bad = F.when(host.isNull() | path.isNull() | host.rlike(r"^$|[A-Z/?#\x1f]") | path.rlike(r"^[^/]|[?#\x1f]") | ~F.coalesce(action.isin("allow", "block"), F.lit(False)), F.concat_ws(" ", F.lit("not a rule (host in lower case, path empty or with /, action):"), host, path, action))
    key = F.when(bad.isNull(), F.concat(host, F.lit(SEP), path)).otherwise(F.raise_error(bad).cast("string"))
    return rules.select(key.alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"), "action")


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every key that a rule of these shapes (labels of the host, characters of the path) could have for a URL: host
    suffixes with path prefixes, longest first, among equals the longest host."""
    labels = F.split(host, r"\.")
    keys = []
    for n, chars in sorted(shapes):
        suffix = F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), ".")
        fits = (F.size(labels) >= n) & (F.length(path) >= chars) & (host != "")
        keys.append(F.when(fits, F.concat(suffix, F.lit(SEP), F.substr(path, F.lit(1), F.lit(chars)))))
    longest = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.locate(SEP, b) - F.locate(SEP, a))
    return F.array_sort(F.array_compact(F.array(*keys)), longest) if keys else F.array().cast("array<string>")


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(F.lit(level), key)
    return [F.pmod(F.shiftrightunsigned(a, 1) % bits + k * (F.shiftrightunsigned(b, 1) % bits), F.lit(bits)) for k in range(hashes)]


def _test(key: Column, level: int, bits: bytes, hashes: int) -> Column:
    """Whether the filter, a string of bytes, has all of the key's bits."""
    table = F.lit(bits)
    byte = lambda p: F.conv(F.hex(F.substr(table, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return reduce(lambda x, y: x & y, [F.getbit(byte(p), F.pmod(p, F.lit(8)).cast("int")) == 1 for p in _positions(key, level, len(bits) * 8, hashes)])


def _build(keys: DataFrame, level: int, bits: int, hashes: int) -> bytes:
    """The filter of ``keys`` (one column, key): set by Spark, gathered as 64-bit words."""
    words = max(1, math.ceil(bits / 64))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, words * 64, hashes))).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("x"))
    out = np.zeros(words, dtype="<i8")
    for r in got.collect():  # one row a word of a filter of bounded size
        out[r["w"]] = r["x"]
    return out.tobytes()


class Cascade:
    """The levels; ``contains(key)`` is exact for keys of the universe that it was built over."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """Both have one column, key, without nulls; listed keys beyond the universe are never asked for and left out."""
        listed = listed.distinct()
        n, u = listed.count(), universe.count()
        self.levels: list[tuple[bytes, int]] = []
        inside, outside, level = listed, universe.join(listed, "key", "left_anti"), 1
        while n:
            hashes, bits = _level_size(n, u, level)
            words = _build(inside, level, bits, hashes)
            self.levels.append((words, hashes))
            wrong = outside.where(_test(F.col("key"), level, words, hashes))
            inside, outside, u = wrong, inside, n
            n, level = inside.count(), level + 1

    def contains(self, key: Column) -> Column:
        out = F.lit(False) if len(self.levels) % 2 == 0 else F.lit(True)
        for k in range(len(self.levels), 0, -1):
            words, hashes = self.levels[k - 1]
            out = F.when(~_test(key, k, words, hashes), F.lit(k % 2 == 0)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def _level_size(n: int, u: int, level: int) -> tuple[int, int]:
    """Hashes and bits of a level that encodes ``n`` keys, where ``u`` others are asked for."""
    rate = min(0.5, n / max(1, 2 * u)) if level == 1 else 0.5
    hashes = max(1, round(-math.log2(rate)))
    return hashes, max(64, math.ceil(n * hashes / math.log(2)))


def membership(universe: DataFrame, listed: DataFrame) -> Callable[[Column], Column]:
    """A test for keys of the universe: one cascade, or several that share a long list by a hash of the key."""
    parts = math.ceil(_level_size(max(1, listed.count()), universe.count(), 1)[1] / MAX_BITS)
    part = lambda key: F.pmod(F.xxhash64(F.lit(parts), key), F.lit(parts))
    own = [Cascade(*(d.where(part(F.col("key")) == i) for d in (universe, listed))) for i in range(parts)]

    def contains(key: Column) -> Column:
        out = own[0].contains(key)
        for i, cascade in enumerate(own[1:], 1):
            out = F.when(part(key) == i, cascade.contains(key)).otherwise(out)
        return out

    return contains


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each URL. rules: (host, path, action), a list or a table of any length.

    A rule's path is any beginning of a URL's path, empty for all. The cascades hold the keys to block and those to allow,
    over all keys that the pages' URLs could match; a URL's rule is the longest key that one of them contains, of equally
    long ones that of the longest host. A key listed with both actions is blocked. A URL without rule is allowed: its keys
    are not listed. Null URLs and URLs without :// have an empty host and path and are allowed; a null page_id stays null;
    repeated rows are judged alike; very long URLs are judged whole. An empty table gives no rows. Other columns are not
    read.
    """
    spark = pages.sparkSession
    listed = rule_keys(rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "host string, path string, action string"))
    listed = materialise(listed, "rules")
    shapes = [(r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect()]  # lengths of hosts and paths
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = materialise(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    blocked, allowed = (membership(universe, listed.where(F.col("action") == a).select("key")) for a in ("block", "allow"))
    out = keyed.withColumn("key", F.get(F.filter("keys", lambda k: blocked(k) | allowed(k)), F.lit(0)))
    verdict = F.when(F.col("key").isNotNull() & blocked(F.col("key")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.replace("key", F.lit(SEP), F.lit("")).alias("rule"), verdict.alias("verdict"))


#: DuckDB SQL for the query's result, without filters.
JUDGE_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, q, act)),
m AS (SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.act FROM p LEFT JOIN r
      ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(act, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id
"""
