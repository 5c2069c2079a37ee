"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage of every document.

A passage is two consecutive chunks of a document, each as long as the index's longest item, so that a copied item lies
within one passage. An item's impacts are its BM25 term weights divided by the score of its own text: a passage that
holds all of an item scores 1, and an item is retrieved where a passage scores ``threshold`` or more.

Block-max WAND: postings are in item order, in blocks of ``BLOCK`` items, with each term's largest impact per block. A
passage's terms' block maxima, summed for all passages of a batch at once, bound what any item of a block can score;
blocks below the threshold are skipped. In the blocks left, WAND moves cursors over the posting lists by pivot.

A retrieved item counts if the document covers its question and its answer: shares of their five-word shingles.

The benchmark is cut into indexes of ``ITEMS`` items, and up to ``PASS_ITEMS`` items are searched in one pass over the
documents, which bounds the broadcast; a larger benchmark takes several passes. Item count, document frequencies, mean length
and passage length are those of the whole benchmark in every index.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, small_batches, worker_state

ITEMS, PASS_ITEMS, BLOCK, THRESHOLD, COVER = 1024, 16_384, 4, 0.6, 0.5
K1, B, SHINGLE = 1.2, 0.75, 5
_OTHER = re.compile(r"[\W_]+")


def term(word: str) -> str:
    """A word's letters and digits, in lower case."""
    return word.lower() if word.isalnum() else _OTHER.sub("", word).lower()


def terms(text: str) -> list[str]:
    return [t for t in map(term, text.split()) if t]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The question ends with the last question mark, or else before the last line; one line is all question."""
    cut = text.rfind("?") + 1 or text.rstrip().rfind("\n") + 1
    if not terms(text[:cut]) or not terms(text[cut:]):
        return terms(text), []
    return terms(text[:cut]), terms(text[cut:])


def _shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def coverage(part: list[str], words: list[str], known: dict[int, set]) -> float:
    """Share of the part's shingles (five words, or all of a shorter part) that are among the document's."""
    if not part:
        return 1.0
    size = min(SHINGLE, len(part))
    if size not in known:
        known[size] = _shingles(words, size)
    own = _shingles(part, size)
    return len(own & known[size]) / len(own)


@dataclass
class Statistics:
    """What an item's weights take from the whole benchmark."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]  # at least of the terms that the index has

    @classmethod
    def of(cls, texts: list[Counter]) -> Statistics:
        lengths = [sum(c.values()) for c in texts]
        return cls(len(texts), sum(lengths) / max(1, len(lengths)), max(lengths, default=1), Counter(w for c in texts for w in c))


@dataclass
class Maxima:
    """Each term's largest impact in each block that has it, by term."""

    shape: tuple[int, int]
    first: np.ndarray  # term -> its place in the next two
    block: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, postings: list[dict[int, list[tuple[int, float]]]], blocks: int) -> Maxima:
        own = [(b, max(x for _, x in rows)) for p in postings for b, rows in sorted(p.items())]
        first = np.concatenate(([0], np.cumsum([len(p) for p in postings], dtype=np.int64)))
        return cls((len(postings), blocks), first, np.array([b for b, _ in own], dtype=np.int64), np.array([x for _, x in own], dtype=np.float64))

    def sums(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """n rows x blocks: the maxima of the terms of each row, added up."""
        width = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        return np.bincount(np.repeat(rows, width) * self.shape[1] + self.block[at], weights=self.impact[at], minlength=n * self.shape[1]).reshape(n, self.shape[1])


@dataclass
class Index:
    items: list[int]
    parts: list[tuple[list[str], list[str]]]
    vocabulary: dict[str, int]
    postings: list[dict[int, list[tuple[int, float]]]]  # per term: block -> (item, impact) in item order
    maxima: Maxima
    longest: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
        """whole: the benchmark's statistics, where ``rows`` are only a block of it."""
        rows = sorted((i, t) for i, t in rows if i is not None and t and terms(t))
        texts = [Counter(terms(t)) for _, t in rows]
        lengths = [sum(c.values()) for c in texts]
        whole = whole or Statistics.of(texts)
        mean, df = whole.mean, whole.df
        vocabulary = {w: i for i, w in enumerate(sorted({w for c in texts for w in c}))}
        postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in vocabulary]
        for d, (c, n) in enumerate(zip(texts, lengths, strict=True)):
            weight = {w: math.log(1 + (whole.items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean)) for w, tf in c.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                t = vocabulary[w]
                postings[t].setdefault(d // BLOCK, []).append((d, x / total))
        maxima = Maxima.of(postings, max(1, math.ceil(len(rows) / BLOCK)))
        return cls([i for i, _ in rows], [question_answer(t) for _, t in rows], vocabulary, postings, maxima, whole.longest)

    def search(self, query: list[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of at least ``threshold`` in the given blocks, by WAND: lists in order of their cursors; the
        pivot is the first whose block maxima, summed so far, reach the threshold."""
        found = []
        for b in blocks:
            lists = []
            for t in query:
                own = self.postings[t].get(b)
                if own:
                    lists.append([own[0][0], 0, own, max(x for _, x in own)])
            end = (b + 1) * BLOCK
            while lists:
                lists.sort(key=lambda x: x[0])
                bound, pivot = 0.0, None
                for x in lists:
                    bound += x[3]
                    if bound >= threshold - 1e-6:
                        pivot = x[0]
                        break
                if pivot is None:
                    break
                if lists[0][0] == pivot:
                    score = sum(x[2][x[1]][1] for x in lists if x[0] == pivot)
                    if score >= threshold - 1e-9:
                        found.append((pivot, score))
                target = pivot + 1 if lists[0][0] == pivot else pivot
                for x in lists:
                    while x[1] < len(x[2]) and x[2][x[1]][0] < target:
                        x[1] += 1
                    x[0] = x[2][x[1]][0] if x[1] < len(x[2]) else end
                lists = [x for x in lists if x[0] < end]
        return found


def passages(index: Index, docs: list[np.ndarray], threshold: float) -> Iterator[tuple[int, list[int], list[int]]]:
    """(document's place, terms, blocks) of each passage that may hold an item. docs: term numbers, -1 for none."""
    size, width = index.longest, len(index.postings)
    keys, base, owner = [], 0, []
    for i, codes in enumerate(docs):
        at = np.flatnonzero(codes >= 0)
        n = len(codes) // size + 2  # an empty chunk ends each document
        keys.append((at // size + base) * width + codes[at])
        owner += [i] * n
        base += n
    if not base or not sum(map(len, keys)):
        return
    own = np.unique(np.concatenate(keys))
    chunk, code = own // width, own % width
    bound = index.maxima.sums(chunk, code, base + 1)
    pairs = bound[:-1] + bound[1:]
    first = np.searchsorted(chunk, np.arange(base + 2))
    for k in np.flatnonzero((pairs >= threshold - 1e-4).any(axis=1)).tolist():
        if k + 1 < base and owner[k + 1] != owner[k]:
            continue
        query = np.unique(code[first[k] : first[k + 2]])
        exact = index.maxima.sums(np.zeros(len(query), dtype=np.int64), query, 1)[0]
        blocks = np.flatnonzero(exact >= threshold - 1e-4).tolist()
        if blocks:
            yield owner[k], query.tolist(), blocks


def _blocks_of(benchmark: DataFrame, items: int) -> Iterator[list[tuple[int, str]]]:
    rows = []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == items:
            yield rows
            rows = []
    if rows:
        yield rows


def _item_terms(benchmark: DataFrame) -> DataFrame:
    """(length, terms): each item's number of terms and its different terms; items without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [w for w in map(terms, batch.column(0).to_pylist()) if w]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, own), pa.int64()), pa.array([sorted(set(w)) for w in own], pa.list_(pa.string()))], names=["length", "terms"])

    return benchmark.where("item_id is not null and text is not null").select("text").mapInArrow(run, "length long, terms array<string>")


def _statistics(benchmark: DataFrame, items: int) -> Callable[[list[tuple[int, str]]], Statistics | None]:
    """Gives the whole benchmark's statistics for a block's terms; none where one block is all of it."""
    if benchmark.where("item_id is not null and text is not null").limit(items + 1).count() <= items:
        return lambda rows: None
    own = _item_terms(benchmark)
    n, total, longest = own.agg(F.count("*"), F.sum("length"), F.max("length")).first()
    counts = materialise(own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")

    def of(rows: list[tuple[int, str]]) -> Statistics:
        wanted = sorted({w for _, t in rows for w in terms(t)})
        found = counts.join(counts.sparkSession.createDataFrame([(w,) for w in wanted], "term string"), "term", "left_semi").collect()
        return Statistics(n, total / max(1, n) if n else 0.0, longest or 1, {r["term"]: r["df"] for r in found})

    return of


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, cover: float = COVER, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_cover, answer_cover): items that a document holds, the best score of its passages.

    Null and empty texts, on either side, hold nothing and are held by nothing; so do texts without letters or digits.
    Rows without doc_id or item_id are left out. Items with equal texts are each reported; repeated rows give one row.
    Very long texts are searched whole. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pass_indexes = max(1, PASS_ITEMS // items)
    schema = "doc_id long, item_id long, score double, question_cover double, answer_cover double"
    out = spark.createDataFrame([], schema)
    whole = _statistics(benchmark, items)
    todo = _blocks_of(benchmark, items)
    while blocks := list(islice(todo, pass_indexes)):
        shared = spark.sparkContext.broadcast([Index.build(rows, whole(rows)) for rows in blocks])
        token = f"terms {uuid.uuid4().hex}"
        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(_searcher(shared, token, threshold, cover), schema))
    best = F.max(F.struct("score", "question_cover", "answer_cover"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def _searcher(shared, token: str, threshold: float, cover: float, keep: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: list[Index] = shared.value
        # a term's number in each index, -1 for none; words without letters or digits have none
        numbers: dict[str, tuple[int, ...]] = worker_state(f"numbers {token}", lambda: _numbers(indexes), 2)
        known: dict[str, tuple[int, ...]] = worker_state(token, dict, 2)
        nowhere, none = (-1,) * len(indexes), (-2,) * len(indexes)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            codes: list[list[np.ndarray]] = [[] for _ in indexes]
            for text in texts:
                words = (text or "").split()
                try:
                    got = list(map(known.__getitem__, words))
                except KeyError:
                    missing = set(words).difference(known)
                    if len(known) + len(missing) > keep:
                        known.clear()
                        missing = set(words)
                    known.update((w, numbers.get(t, nowhere) if (t := term(w)) else none) for w in missing)
                    got = list(map(known.__getitem__, words))
                table = np.array(got, dtype=np.int32).reshape(-1, len(indexes))
                table = table[table[:, 0] > -2]
                for k, own in enumerate(codes):
                    own.append(table[:, k])
            hits: dict[int, dict[tuple[int, int], float]] = defaultdict(dict)
            for k, index in enumerate(indexes):
                for i, query, blocks in passages(index, codes[k], threshold):
                    for d, score in index.search(query, blocks, threshold):
                        hits[i][k, d] = max(score, hits[i].get((k, d), 0.0))
            out = []
            for i, found in hits.items():
                words, sets = terms(texts[i]), {}
                for (k, d), score in found.items():
                    q, a = (coverage(p, words, sets) for p in indexes[k].parts[d])
                    if q >= cover and a >= cover:
                        out.append((ids[i], indexes[k].items[d], score, q, a))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "question_cover", "answer_cover"])

    return run


def _numbers(indexes: list[Index]) -> dict[str, tuple[int, ...]]:
    every = {t for index in indexes for t in index.vocabulary}
    return {t: tuple(index.vocabulary.get(t, -1) for index in indexes) for t in every}


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item of the benchmark: all rows of their doc_id; rows without one stay."""
    gone = materialise(contamination(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
