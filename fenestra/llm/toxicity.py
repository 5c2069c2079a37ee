"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters look for stems (beginnings of words): a small seed lexicon of English insults, stems that the labelled rows show
to go with toxic texts, and patterns (second-person address, shouting, exclamation). Each voter votes toxic, clean or
abstains. The label model, fitted by expectation maximisation on a bounded sample of the labelled rows, is a tree given the
class: it estimates every voter's accuracy together with the voter it goes with most, so that voters that repeat each other
count once; the marks are one more voter. Its posteriors are the labels of a logistic regression on the texts' stem counts
and patterns, which scores every whole text. A score depends on the text alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, small_batches, worker_state

#: Labelled rows in the sample at most, about: larger label tables are thinned by a hash of doc_id.
SAMPLE_ROWS = 12_000
#: Stems that become voters at most (the most telling), and the share of toxic ones that its texts need.
STEMS, LEAST_SHARE = 192, 0.9
#: A stem of this many toxic texts is taken; one of fewer needs repeats in them and no clean text.
MANY_TOXIC, FEW_TOXIC, REPEATS = 10, 4, 1.5
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Seed lexicon of insults. Fixed values.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_YOU = re.compile(r"\b(?:you|your|du|dich|tu|toi|vous|usted)\b", re.I)
PATTERNS = 3


def _clean(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>#*$%&|-_").lower()


def stems_of(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    w = _clean(word)
    return [w + "$", *[w[:n] for n in STEM_LENGTHS if len(w) >= n]] if w else []


@dataclass
class Voters:
    """Stems, numbered; ``count`` gives how often each of them, and each pattern, occurs in a text."""

    stems: dict[str, int]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _hits(self, word: str) -> tuple[int, ...]:
        return tuple(self.stems[s] for s in stems_of(word) if s in self.stems)

    def count(self, text: str | None, keep: int = 300_000) -> tuple[dict[int, int], int, tuple[float, float, float]]:
        """Hits per stem, words, and the patterns' strengths from 0 to 1."""
        words = (text or "").split()
        try:
            hits = [h for h in map(self.known.__getitem__, words) if h]
        except KeyError:
            missing = set(words).difference(self.known)
            if len(self.known) + len(missing) > keep:
                self.known.clear()
                missing = set(words)
            self.known.update((w, self._hits(w)) for w in missing)
            hits = [h for h in map(self.known.__getitem__, words) if h]
        out: dict[int, int] = {}
        for h in hits:
            for s in h:
                out[s] = out.get(s, 0) + 1
        n = max(1, len(words))
        text = text or ""
        return out, len(words), (min(1.0, 20 * len(_YOU.findall(text)) / n) if hits else 0.0, min(1.0, 10 * text.count("!") / n), min(1.0, 4 * text.count("!!") / n))


def features(voters: Voters, text: str | None) -> np.ndarray:
    """What the classifier sees: log counts of stems, the share of words hit, whether any is, the patterns."""
    hits, n, patterns = voters.count(text)
    x = np.zeros(len(voters.stems) + 2 + PATTERNS, dtype=np.float32)
    for s, c in hits.items():
        x[s] = np.log1p(c)
    at = len(voters.stems)
    total = max(hits.values(), default=0)
    x[at : at + 2] = min(1.0, 50.0 * total / max(1, n)), float(total > 0)
    x[at + 2 :] = patterns
    return x


#: Evidence (twice the gain in log-likelihood) that a voter must show of going with another, given the class.
LEAST_EVIDENCE = 30.0
MARKS_RIGHT = 0.85


def voter_tree(onehot: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent of each voter or -1, strength of that tie): the spanning forest of largest mutual information given the class
    (Chow and Liu's tree). onehot: rows x voters x 3."""
    n, m, _ = onehot.shape
    flat = onehot.reshape(n, 3 * m)
    gain = np.zeros((m, m))
    for p in (1 - post, post):
        joint = ((flat * p[:, None]).T @ flat).reshape(m, 3, m, 3) + 1e-9
        total = p.sum() + 1e-9
        own = np.einsum("iaia->ia", joint)
        ratio = joint * total / (own[:, :, None, None] * own[None, None] + 1e-12)
        gain += 2 * (joint * np.log(np.maximum(ratio, 1e-12))).sum(axis=(1, 3))
    np.fill_diagonal(gain, 0)
    parent, tie = np.full(m, -1), np.zeros(m)
    best, near, todo = np.full(m, -1.0), np.full(m, -1), np.ones(m, dtype=bool)
    for _ in range(m):  # Prim; a voter without enough evidence for a tie starts a tree of its own
        j = int(np.where(todo, best, -np.inf).argmax())
        todo[j] = False
        if near[j] >= 0 and best[j] >= LEAST_EVIDENCE:
            parent[j], tie[j] = near[j], best[j]
        closer = todo & (gain[j] > best)
        best[closer], near[closer] = gain[j][closer], j
    return parent, tie


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, and each voter's weight: the share of it that its ties leave as evidence of its own.

    votes: rows x voters of 1 (toxic), 0 (clean) or -1 (abstains). gold: the marks, one more voter of high prior accuracy.
    The model is P(class) times each voter's vote given the class and the vote of its parent in :func:`voter_tree`; the
    tree is found anew while the posterior settles. Half of what the tables are estimated from is always the marks, as if
    right in ``MARKS_RIGHT`` of all rows: else the class would come to mean whatever most voters have in common.
    """
    votes = np.concatenate([votes, gold[:, None]], axis=1)
    n, m = votes.shape
    marked = np.where(gold == 1, MARKS_RIGHT, 1 - MARKS_RIGHT)
    post = marked
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    code = votes + 1
    parent = np.full(m, -1)
    for step in range(rounds):
        if step % 8 == 0:
            parent, _ = voter_tree(onehot, (marked + post) / 2)
            parent[-1] = -1  # the marks' table is given
        with_parent = np.where(parent >= 0, code[:, parent], 0)  # rows x voters: the parent's vote, 0 without one
        at = with_parent * 3 + code
        prior = np.clip(post.mean(), 0.01, 0.99)
        odds = np.full(n, np.log(prior / (1 - prior)))
        used = (marked + post) / 2
        for sign, p in ((-1, 1 - used), (1, used)):
            counts = np.stack([np.bincount(at[:, j], weights=p, minlength=9) for j in range(m)]).reshape(m, 3, 3)
            # a tied pair's table leans on the voter's own one where it has few rows
            own = counts.sum(axis=1) + 1.0
            own /= own.sum(axis=1, keepdims=True)
            table = np.log((counts + 2 * own[:, None, :]) / (counts.sum(axis=2, keepdims=True) + 2))
            table[-1, :, 1:] = np.log([MARKS_RIGHT, 1 - MARKS_RIGHT] if sign < 0 else [1 - MARKS_RIGHT, MARKS_RIGHT])
            odds += sign * table[np.arange(m), with_parent, code].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, post = step > 10 and np.abs(new - post).max() < 1e-6, new
        if done:
            break
    weight = np.ones(m)
    toxic = onehot[:, :, 2]
    spread = toxic - np.outer(post, (toxic * post[:, None]).sum(0) / max(post.sum(), 1)) - np.outer(1 - post, (toxic * (1 - post)[:, None]).sum(0) / max((1 - post).sum(), 1))
    for j in np.flatnonzero(parent >= 0):
        a, b = spread[:, j], spread[:, parent[j]]
        r = abs(a @ b) / (np.sqrt((a @ a) * (b @ b)) + 1e-9)
        weight[j] -= r / 2
        weight[parent[j]] = max(weight[parent[j]] - r / 2, 1 / m)
    return post, weight[:-1]


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft labels, with the intercept last (Nesterov's method, full batches)."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    look, step = w.copy(), 4.0 / max(1e-9, float((x**2).sum(axis=1).mean()))
    for t in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ look, -30, 30))) - y) / len(x) + penalty * np.append(look[:-1], 0)
        new = look - step * g
        look, w = new + t / (t + 3) * (new - w), new
    return w


@dataclass
class Model:
    stems: dict[str, int]
    weights: np.ndarray


def _seed_model() -> Model:
    stems = {s + "$": i for i, s in enumerate(SEEDS)}
    return Model(stems, np.array([1.5] * len(stems) + [1.0, 3.0] + [0.0] * PATTERNS + [-3.0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the texts of the labelled rows given (doc_id, toxic), ``sample_rows`` of them at most, about.

    Null marks and null ids are left out; a doc_id marked twice counts as toxic if any mark says so. Without both toxic
    and clean rows the seed lexicon alone scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # a table of ids and marks: Spark sees its size and broadcasts it only where it is small
    chosen = materialise(chosen, "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic")
    sample = materialise(sample, "sample")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, n in Counter(s for w in (text or "").split() for s in stems_of(w)).items():
                    own = seen.setdefault(s, [0, 0, 0])
                    own[toxic] += 1
                    own[2] += toxic * min(n, 3)
            counts = [pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], names=["stem", "clean", "toxic", "hits"])

    mined = sample.select("text", "toxic").mapInArrow(mine, "stem string, clean long, toxic long, hits long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("hits").alias("hits"))
    many = (F.col("toxic") >= MANY_TOXIC) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))
    telling = mined.where(many | (F.col("toxic") >= FEW_TOXIC) & (F.col("clean") == 0) & (F.col("hits") >= REPEATS * F.col("toxic")))
    top = [r["stem"] for r in telling.orderBy(F.col("toxic").desc(), "stem").limit(STEMS).collect()]
    stems = {s: i for i, s in enumerate(dict.fromkeys([s + "$" for s in SEEDS] + top))}

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            x = [features(voters, t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["_id", "toxic", "x"])

    got = sample.mapInArrow(table, "_id long, toxic int, x binary").toArrow().sort_by("_id")
    y = np.asarray(got.column("toxic").to_pylist(), dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return _seed_model()
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in got.column("x").to_pylist()])
    k = len(stems)
    any_hit = (x[:, :k] > 0).any(axis=1)
    votes = np.where(x[:, :k] > 0, 1, -1)
    silent = np.where(any_hit, -1, 0)[:, None]  # no stem at all: a vote for clean
    dense = np.where(x[:, k] >= 0.5, 1, np.where(x[:, k] == 0, 0, -1))[:, None]
    patterns = np.where(x[:, k + 2 :] >= 0.5, 1, -1)
    post, _ = label_model(np.concatenate([votes, silent, dense, patterns], axis=1), y)
    return Model(stems, fit_linear(x, post))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts score by the intercept. Repeated rows score alike.

    An empty table gives no rows. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"voters {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = worker_state(token, lambda: Voters(shared.value.stems)), shared.value.weights
        for batch in batches:
            x = np.stack([features(voters, t) for t in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, len(w) - 1))
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
