"""Quality rules with an n-gram language model: a modified Kneser-Ney model over the characters of words.

The corpus is counted by Spark: every word of every text, as character 5-grams within the word (padded in front, with
an end mark), per language. Every different n-gram of every language keeps its own count, so the model grows with the
corpus. It is sorted arrays of slots, 64-bit hashes of language and characters, with interpolated log probabilities, and
of contexts with backoff weights; workers look slots up by binary search and remember the score of each word, as it
depends on the word alone.

Perplexity of a text: two to the mean number of bits per word, end marks included. Each language's band follows
from the quartiles of all its texts; texts below or above it are rejected.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialise, small_batches, worker_state

ORDER = 5
#: Interquartile ranges that the band reaches beyond the quartiles.
LOWER, UPPER = 1.5, 3.0
#: The narrowest band, in bits around the median.
LEAST_BITS = 0.5
#: Languages up to which their bands are broadcast.
MAX_BROADCAST_LANGS = 10_000
PAD, END = "\x02", "\x03"
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def _units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words, and where each word's predicted characters are."""
    flat = np.frombuffer("".join([PAD * (ORDER - 1) + w + END for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    return np.lib.stride_tricks.sliding_window_view(flat, ORDER)[at - (ORDER - 1)], lengths


def _slots(cps: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
    """Slots of n-grams (rows of code points) in a language given by its number: all 64 bits of a hash."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(cps), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(lang, dtype=np.uint64) + np.uint64(1 + cps.shape[1]))
        for k in range(cps.shape[1]):
            h = (h ^ cps[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _lang_number(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode())


def _ngram_rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, words in counts.items():
        grams, lengths = _units([w.decode("utf-8", "replace") for w in words])
        slots = _slots(grams, _lang_number(lang))
        n = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), lengths)
        keys, first, back = np.unique(slots, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=n).astype(np.int64)
        text = ["".join(map(chr, g)) for g in grams[first].tolist()]
        number = pa.array(np.full(len(keys), _lang_number(lang), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([number, pa.array(text), pa.array(total)], names=["lang_no", "gram", "n"])


def count_ngrams(docs: DataFrame, flush_words: int = 100_000) -> DataFrame:
    """(lang_no, gram, n) over every word of ``docs``: a row for each different n-gram of each language."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    counts.setdefault(lang or "", Counter()).update(text.split())
            if sum(map(len, counts.values())) > flush_words:
                yield from _ngram_rows(counts)
                counts = {}
        yield from _ngram_rows({k: v for k, v in counts.items() if v})

    rows = docs.select(F.col("text").cast("binary"), "lang").mapInArrow(run, "lang_no long, gram string, n long")
    return rows.groupBy("lang_no", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Per order: sorted slots with log2 probabilities, and sorted context slots with log2 backoff weights."""

    slots: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    @classmethod
    def fit(cls, grams: list[str], lang_no: np.ndarray, n: np.ndarray) -> KneserNey:
        """grams: the n-grams in order, each alone or several in one string."""
        if not len(n):
            return cls([], [], [], [], -8.0)
        cps = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, ORDER)
        counts, rows = n.astype(np.float64), np.arange(len(n))
        levels = []
        for k in range(ORDER, 0, -1):
            keys, first, back = np.unique(_slots(cps[rows][:, ORDER - k :], lang_no[rows]), return_index=True, return_inverse=True)
            # the highest order has the words' counts, lower ones the number of different n-grams that they end
            c = np.bincount(back, weights=counts if k == ORDER else np.ones(len(rows)))
            rows = rows[first]
            levels.append((k, keys, c, rows))
        chars = len(np.unique(cps[:, -1])) + 1
        out: dict[int, tuple] = {}
        lower_slots = lower_logp = None
        floor = -float(np.log2(chars))
        for k, keys, c, rows in reversed(levels):
            d = cls._discounts(c)
            ctx_keys, ctx = np.unique(_slots(cps[rows][:, ORDER - k : ORDER - 1], lang_no[rows]), return_inverse=True)
            total = np.bincount(ctx, weights=c)
            mass = np.bincount(ctx, weights=d[np.minimum(c, 3).astype(int)])
            gamma = np.maximum(mass / total, 1e-9)
            base = np.full(len(keys), 1.0 / chars) if lower_slots is None else 2.0 ** lower_logp[np.searchsorted(lower_slots, _slots(cps[rows][:, ORDER - k + 1 :], lang_no[rows]))]
            p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total[ctx] + gamma[ctx] * base
            lower_slots, lower_logp = keys, np.log2(p).astype(np.float32)
            out[k] = (keys, lower_logp, ctx_keys, np.log2(gamma).astype(np.float32))
        return cls(*[[out[k][i] for k in range(1, ORDER + 1)] for i in range(4)], floor)

    @staticmethod
    def _discounts(c: np.ndarray) -> np.ndarray:
        """Discounts for counts 0 (none), 1, 2 and 3 or more, by the counts of counts; 0.5, 1 and 1.5 where those are too few."""
        n1, n2, n3, n4 = (float((c == i).sum()) for i in (1, 2, 3, 4))
        plain = np.array([0.0, 0.5, 1.0, 1.5])
        if min(n1, n2, n3, n4) == 0:
            return plain
        y = n1 / (n1 + 2 * n2)
        found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        return np.where((found < 0) | (found > np.arange(4)), plain, found)

    def bits(self, words: list[str], lang_no: int) -> list[float]:
        """log2 probability of each word with its end mark."""
        grams, lengths = _units(words)
        score, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(len(self.slots), 0, -1):
            s = _slots(grams[todo][:, ORDER - k :], lang_no)
            at = np.minimum(np.searchsorted(self.slots[k - 1], s), len(self.slots[k - 1]) - 1)
            hit = self.slots[k - 1][at] == s
            score[todo[hit]] += self.logp[k - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            x = _slots(grams[todo][:, ORDER - k : ORDER - 1], lang_no)
            at = np.minimum(np.searchsorted(self.contexts[k - 1], x), len(self.contexts[k - 1]) - 1)
            score[todo] += np.where(self.contexts[k - 1][at] == x, self.backoff[k - 1][at], 0)
        else:
            score[todo] += self.floor
        return np.add.reduceat(score, np.cumsum(lengths) - lengths).tolist()


def fit_model(docs: DataFrame) -> KneserNey:
    got = count_ngrams(docs).toArrow()
    # strings of a chunk at a time: a list of every n-gram would be many times the table
    grams = ["".join(c.to_pylist()) for c in got.column("gram").chunks]
    return KneserNey.fit(grams, got.column("lang_no").to_numpy(), got.column("n").to_numpy())


_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in ``window``-word windows found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:n] * _ODD[0]
        for k in range(1, window):
            w += h[k : n + k] * _ODD[k]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    maybe = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))]).tolist()
    found = Counter(tuple(words[i : i + window]) for i in maybe)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    hits = np.array([i for i in maybe if found[tuple(words[i : i + window])] > 1], dtype=np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    chars = len(text.translate(None, SPACE).decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits")
TYPES = (*[pa.int64()] * 5, pa.float64())
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double"


def _scorer(lm: KneserNey, token: str, keep_words: int) -> Callable[[pa.Array, pa.Array], list[pa.Array]]:
    """From texts and languages to the columns ``FIELDS``, in a worker."""
    memo = worker_state(token, dict)

    def one(text: bytes | None, lang: str | None) -> tuple:
        words = (text or b"").split()
        counts = text_counts(text or b"", words)
        if not words:
            return (*counts, None)
        known = memo.setdefault(lang or "", {})
        try:
            total = sum(map(known.__getitem__, words))
        except KeyError:
            missing = list(set(words).difference(known))
            if sum(map(len, memo.values())) + len(missing) > keep_words:
                memo.clear()
                known = memo.setdefault(lang or "", {})
                missing = list(set(words))
            known.update(zip(missing, lm.bits([w.decode("utf-8", "replace") for w in missing], _lang_number(lang)), strict=True))
            total = sum(map(known.__getitem__, words))
        return (*counts, -total / counts[0])

    def columns(texts: pa.Array, langs: pa.Array) -> list[pa.Array]:
        rows = list(map(one, texts.to_pylist(), langs.to_pylist()))
        cols = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
        return [pa.array(list(c), t) for c, t in zip(cols, TYPES, strict=True)]

    return columns


def score(docs: DataFrame, model: KneserNey, keep_words: int = 300_000) -> DataFrame:
    """doc_id and lang of every row, with the counts of its text and its mean bits per word (null without words)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"words {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _scorer(shared.value, token, keep_words)
        for batch in batches:
            langs = pa.array([x or "" for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, *columns(batch.column(1), langs)], names=["doc_id", "lang", *FIELDS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "lang").mapInArrow(run, f"doc_id long, lang string, {SCHEMA}")


def with_scores(docs: DataFrame, model: KneserNey, name: str, keep_words: int = 300_000) -> DataFrame:
    """``docs`` with what :func:`score` finds for each row as a struct ``name`` beside its other columns, which stay in the JVM."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"words {uuid.uuid4().hex}"

    @F.arrow_udf(SCHEMA)
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        columns = _scorer(shared.value, token, keep_words)
        for texts, langs in batches:
            yield pa.StructArray.from_arrays(columns(texts, langs), names=list(FIELDS))

    return docs.withColumn(name, scores(F.col("text").cast("binary"), F.col("lang")))


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER, least: float = LEAST_BITS) -> DataFrame:
    """(lang, low, high): each language's band of bits, from the quartiles of its texts (to 1/1000 bit; a bounded histogram)."""
    hist = scored.where("bits is not null").groupBy("lang", F.round("bits", 3).alias("b")).count()
    hist = hist.withColumn("part", F.floor("b"))  # sums run within whole bits, then over these
    parts = hist.groupBy("lang", "part").agg(F.sum("count").alias("pn"))
    before = F.coalesce(F.sum("pn").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("lang", "part", before.alias("p0"), F.sum("pn").over(W.partitionBy("lang")).alias("n"))
    up = W.partitionBy("lang", "part").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    cum = hist.withColumn("c", F.sum("count").over(up)).join(parts, ["lang", "part"]).select("lang", "b", (F.col("p0") + F.col("c")).alias("c"), "n")
    q = lambda p: F.min(F.when(F.col("c") >= F.col("n") * p, F.col("b")))
    quart = cum.groupBy("lang").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return quart.select("lang", F.least(F.col("q1") - lower * iqr, F.col("q2") - least).alias("low"), F.greatest(F.col("q3") + upper * iqr, F.col("q2") + least).alias("high"))


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base rules, perplexity and verdict of each document.

    Null and empty texts have no words: all counts are 0, they fail the base rules and are not kept. A null lang is a
    language of its own. Repeated rows each get a row; ties don't arise. An empty table gives no rows. Other columns are
    not read.
    """
    scored = materialise(score(docs, fit_model(docs)), "scored")
    return scored.join(_limits(scored), "lang", "left").withColumn("base_failed", _base_failed("n_words", "n_repeat_words")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & _inside("bits", "low", "high")).alias("kept"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"), "lang")


def _base_failed(words: str, repeated: str) -> F.Column:
    return (F.col(words) < 20) | (100 * F.col(repeated) > 30 * F.col(words))


def _inside(bits: str, low: str, high: str) -> F.Column:
    return F.coalesce(F.col(bits).between(F.col(low), F.col(high)), F.lit(False))


def _limits(scored: DataFrame) -> DataFrame:
    """The bands, to be broadcast: languages are few. The size is looked at, and a table of very many is joined by shuffle."""
    limits = materialise(bands(scored), "bands")
    return F.broadcast(limits) if limits.count() <= MAX_BROADCAST_LANGS else limits


def quality_filter(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects. Each row is judged by itself, whatever its doc_id.

    Scores are written beside the rows they belong to, so that no text is shuffled to meet its verdict (but for tables of
    more than ``MAX_BROADCAST_LANGS`` languages)."""
    taken = {c.lower() for c in docs.columns}
    prefix = "_"
    while taken & {f"{prefix}score", f"{prefix}band"}:
        prefix += "_"
    own, band = f"{prefix}score", f"{prefix}band"
    rows = materialise(with_scores(docs, fit_model(docs), own), "scored")
    lang = F.coalesce("lang", F.lit(""))
    limits = _limits(rows.select(lang.alias("lang"), f"{own}.bits")).select(F.struct("lang", "low", "high").alias(band))
    kept = ~_base_failed(f"{own}.n_words", f"{own}.n_repeat_words") & _inside(f"{own}.bits", f"{band}.low", f"{band}.high")
    return rows.join(limits, lang == F.col(f"{band}.lang")).where(kept).drop(own, band)
