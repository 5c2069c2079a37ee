"""Encoding whole texts with a public tokenizer, and the exact length histogram.

The word BPE drops white space and never merges across it, so a text's ids are its words' ids, joined. Each Python
worker keeps the ids of words it has met (a bounded cache, refilled by the tokenizer itself), which makes encoding
mostly dictionary lookups. Texts that spell one of the special tokens go to the tokenizer whole.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import small_batches, worker_state

TOKENIZER = "word_bpe_49k.json"
#: Words in one generation of a worker's cache; beyond that a new one starts, and takes over what it meets of the last one.
CACHE_WORDS = 600_000
#: A character that the tokenizer gives one id, which no other text has.
MARK = "\x01"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes (``value`` may turn them into something else that adds up)."""

    def __init__(self, path: str, value: Callable[[bytes], object] = bytes, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.value, self.limit, self.cache, self.old = Tokenizer.from_file(path), value, cache_words, {}, {}
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids[0]
        self._try_out()

    def _try_out(self) -> None:
        """Checks on probes that this tokenizer has the properties that word-wise encoding takes for granted; one that lacks
        the first encodes whole texts, one that lacks the second every word as it is spelled."""
        one = lambda t: self._ids([t])[0]
        pairs = [("Abc", "def"), ("x.", "Y,"), ("été", "Übung"), ("12", "a-b"), ("日本", "語")]
        texts = [f"{a}{gap}{b}" for a, b in pairs for gap in (" ", "  ", "\n")] + [f" {MARK} "]
        joined = [one(a) + one(b) for a, b in pairs for _ in range(3)] + [one(MARK)]
        self.by_words = len(one(MARK)) == 4 and all(one(t) == j for t, j in zip(texts, joined, strict=True))
        cased = ["Word", "WORDS", "Été", "ÜBUNG", "Ñandú", "McDonald", "ÀÖÞ"]
        self.folds = self.by_words and all(one(w + m) == one(w.lower()) + (one(m) if m else b"") for w in cased for m in ("", ".", ","))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without spaces: many are encoded as one text, with a mark between them that is a word of its own."""
        plain = [w for w in words if MARK not in w]
        out = dict(zip(odd, self._ids(odd), strict=True)) if (odd := [w for w in words if MARK in w]) else {}
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.asarray(self.tok.encode_batch_fast([f" {MARK} ".join([*part, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            assert len(ends) == len(part)
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                out[w] = raw[4 * start : 4 * end]
                start = end + 1
        return [out[w] for w in words]

    def words(self, text: str) -> list:
        """The values of the text's words, in order."""
        if "<|" in text or not self.by_words:
            return [self.value(self._ids([text])[0])]
        words = text.replace("\n", " ").split(" ")
        try:
            return list(map(self.cache.__getitem__, words))
        except KeyError:
            missing = set(words).difference(self.cache)
            if len(self.cache) + len(missing) > self.limit:
                self.old, self.cache = self.cache, {}
                missing = set(words)
            known = missing & self.old.keys()
            self.cache.update((w, self.old[w]) for w in known)
            self._fill(missing - known)
            return list(map(self.cache.__getitem__, words))

    def _fill(self, missing: set[str]) -> None:
        """Encodes words the cache lacks. Letters of Latin-1, with one full stop or comma at most, are known by their lower
        case and the mark apart, as the tokenizer folds case and never merges letters with marks."""
        cache, old, encode, derived = self.cache, self.old, set(), []
        for w in missing:
            low = w.lower()
            base, mark = (low[:-1], low[-1]) if low[-1:] in (".", ",") else (low, "")
            if self.folds and base != w and base.isalpha() and (base.isascii() or max(base) <= "ÿ") and (w.isascii() or max(w) <= "ÿ"):
                derived.append((w, base, mark))
                if base in old:
                    cache[base] = old[base]
                elif base not in cache:
                    encode.add(base)
            else:
                encode.add(w)
        encode.update(m for m in ("", ".", ",") if m not in cache)
        words = list(encode)
        cache.update(zip(words, map(self.value, self._ids_of_words(words)), strict=True))
        cache.update((w, cache[base] + cache[mark]) for w, base, mark in derived)

    def ids(self, text: str) -> bytes:
        return b"".join(self.words(text))


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def token_pieces(docs: DataFrame, context: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece of at most ``context`` ids of each document's ids followed by ``end_id``.

    Null and empty texts give the end id alone. Rows with the same doc_id are encoded each on its own. Only doc_id and
    text are read, whatever other columns there are.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = worker_state(f"ids {path}", lambda: WordEncoder(path)), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (enc.ids(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, context):
                    part = ids[4 * start : 4 * (start + context)]
                    for col, v in zip(out, (doc_id, start, len(part) // 4, part, n), strict=True):
                        col.append(v)
                if len(out[0]) >= 1024:
                    yield _pieces(out)
                    out = ([], [], [], [], [])
            if out[0]:
                yield _pieces(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _pieces(cols: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, without special ids.

    Null and empty texts have length 0; every row counts, repeated ones too. An empty table gives no rows.
    """
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = worker_state(f"lengths {path}", lambda: WordEncoder(path, lambda b: len(b) // 4)), Counter()
        for batch in batches:
            seen.update(sum(enc.words(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_totals(hist: DataFrame, block: int = 1024) -> DataFrame:
    """Suffix sums of a length histogram: one row per length L that occurs.

    docs_at_least, tokens_at_least: documents of L ids or more, and their ids. truncated_total: ids left if every
    document is cut to L. quantile: share of documents of at most L. total_docs, total_tokens: of the whole table. For a
    limit between two lengths a < L <= b, docs_at_least(b) * L plus the tokens below b is exact, so these rows answer
    every limit. Sums run within blocks of ``block`` lengths and then over the few block totals, so that no task reads
    all lengths.
    """
    cells = hist.select("n_tokens", "n_docs", F.expr(f"n_tokens div {block}").alias("b"), (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    after = W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = cells.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt")).select(
        "b", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"),
        F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    within = W.partitionBy("b").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = cells.join(blocks, "b").withColumns({"docs_at_least": F.col("ad") + F.sum("n_docs").over(within), "tokens_at_least": F.col("at") + F.sum("t").over(within)})
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        "total_docs", "total_tokens")
