"""Near duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

1. Every text becomes its set of 64-bit shingle hashes, ``BANDS * ROWS`` MinHash samples, and an odd sketch: each sample
   flips one bit of a ``SKETCH_BITS`` bitmap, so that the XOR of two bitmaps counts the samples in which two documents
   differ, and its population count estimates their similarity.
2. Equal sets form a class; only the class's smallest document goes on.
3. Documents that share a band are candidates. In each bucket every member is compared with the smallest one. What those
   links leave unconnected is compared across the components that meet in a bucket, block by block within tasks.
4. Candidates whose odd sketches are too far apart are dropped (a true link fails with a chance below 1e-9); the rest is
   confirmed on the full sets.
5. Links become components by alternating large-star and small-star steps over tables in the shared folder.

With 32 bands of 4 rows a pair at the threshold 0.8 shares no band with a chance of 5e-8, one at 0.85 with 3e-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SHARED_IDS, by_row, materialise, small_batches, worker_state

BANDS, ROWS, SKETCH_BITS, SHINGLE = 32, 4, 512, 5
#: Similarity from which the filter links documents.
THRESHOLD = 0.8
#: Members of a group that one task compares with those of another block.
BLOCK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted 64-bit hashes of a text's different shingles; words' hashes are remembered up to a bound."""

    def __init__(self, size: int = SHINGLE, keep: int = 300_000):
        self.size, self.keep, self.known = size, keep, {}

    def _word(self, words: list[bytes]) -> np.ndarray:
        try:
            got = list(map(self.known.__getitem__, words))
        except KeyError:
            missing = set(words).difference(self.known)
            if len(self.known) + len(missing) > self.keep:
                self.known.clear()
                missing = set(words)
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
            got = list(map(self.known.__getitem__, words))
        return np.array(got, dtype=np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(_LOWER).split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h, n = self._word(words), max(1, len(words) - self.size + 1)
        span = min(self.size, len(words))
        with np.errstate(over="ignore"):
            s = np.full(n, span, dtype=np.uint64)
            for k in range(span):
                s += h[k : n + k] * _STEP[k]
            s = np.sort(_mix(s))
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def minhash(s: np.ndarray, step: int = 512) -> np.ndarray:
    """The samples of a set that is not empty, ``step`` shingles at a time: a block of all samples fits a core's cache."""
    out = np.full(len(_MUL), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), step):
        block = _MUL * s[i : i + step]
        block += _ADD
        np.minimum(out, block.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of (i, sample) as 64-bit words."""
    with np.errstate(over="ignore"):
        at = _mix(samples * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(samples) + 1, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    flips = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch_similarity(differing: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> float:
    """Similarity that a XOR population count stands for."""
    x = min(differing, bits / 2 - 1)
    return 1 + bits / (4 * samples) * float(np.log1p(-2 * x / bits))


def sketch_limit(threshold: float, sigmas: float = 7.0) -> int:
    """The largest XOR population count that a pair at ``threshold`` may have, ``sigmas`` out."""
    k, p = BANDS * ROWS, 1 - threshold
    differ = k * p + sigmas * np.sqrt(k * p * threshold) + 1
    mean = SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS))
    return int(np.ceil(mean + 3 * np.sqrt(mean / 2)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands array<long>, sketch array<long>); the last three null for texts without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_state("shingler", Shingler)
        row = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            n, sets, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    sets.append(None), bands.append(None), sketches.append(None)
                    continue
                sample = minhash(s)
                with np.errstate(over="ignore"):
                    band = _mix((_mix(sample).reshape(BANDS, ROWS) * row).sum(axis=1, dtype=np.uint64) + salt)
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band.view(np.int64))
                sketches.append(odd_sketch(sample).view(np.int64))
            longs = pa.list_(pa.int64())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    schema = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, s): the full sets, for the documents that candidates name."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = worker_state("shingler", Shingler)
        for batch in batches:
            s = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, s array<long>")


def _xor_bits(a: str, b: str) -> F.Column:
    words = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)]
    return sum(words[1:], words[0])


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    sized = full.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return sized.where(F.col("i") * threshold.denominator >= (F.col("t") - F.col("i")) * threshold.numerator).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every row of ``nodes``.

    Large-star and small-star steps in turn until nothing changes; each step's edges are a table in the shared folder.
    """
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = materialise(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last or now[0] == 0:
            break
        last = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _overlaps(one: np.ndarray, values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of one set with each of n sets, given as all their elements in order and their owners."""
    lo, hi = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
    width = hi - lo
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
    return np.bincount(owners[at], minlength=n)


def _links_between(t: pa.Table, limit: int, num: int, den: int) -> pa.Table:
    """Links between different components in one block, or between two blocks, of documents that share bands.

    A pair counts if it shares a band, its odd sketches are near enough and its full sets confirm it. Documents of the
    largest component are not searched for: whatever they link to searches for them. Links that join what is joined
    already are left out, so at most one link a document comes out."""
    t = t.combine_chunks()
    ids, comp, part = (t.column(c).to_numpy() for c in ("a", "component", "part"))
    two = t.column("p")[0].as_py() != t.column("q")[0].as_py()
    sketch = np.array(t.column("sketch").to_pylist(), dtype=np.int64).reshape(len(ids), -1).view(np.uint64)
    # bands that a document shares with nobody are not there; a number of its own stands for them
    bands = np.repeat(np.arange(len(ids), dtype=np.int64)[:, None], BANDS, axis=1)
    for i, (ks, own) in enumerate(zip(t.column("ks").to_pylist(), t.column("bands").to_pylist(), strict=True)):
        bands[i, ks] = own
    sets = [np.asarray(x, dtype=np.int64) for x in t.column("s").to_pylist()]
    size = np.array([len(x) for x in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    _, label = np.unique(comp, return_inverse=True)
    a, b = [], []
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        maybe = label != label[i]
        if two:
            maybe &= part != part[i]
        js = np.flatnonzero(maybe)
        js = js[(bands[js] == bands[i]).any(axis=1)]
        js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= limit]
        if not len(js):
            continue
        both = _overlaps(sets[i], values, owners, len(ids))[js]
        for j in js[both * den >= (size[js] + size[i] - both) * num].tolist():
            if label[j] != label[i]:
                a.append(ids[i])
                b.append(ids[j])
                label[label == label[i]] = label[j]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cross_links(buckets: DataFrame, sketches: DataFrame, sets: DataFrame, limit: int, threshold: Fraction) -> DataFrame:
    """Links that the comparisons with each bucket's smallest member have not shown: (a, b).

    Buckets in which several components meet are joined, by shared members, to larger groups, so that a pair is looked at
    once and not in every band; a group's documents, with their sets, are dealt to blocks, and each pair of blocks is one
    task's work. No pair is written unless it is a link between what was apart."""
    mixed = buckets.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("a").alias("m")).where("lo < hi").select("band", "m")
    rows = materialise(buckets.join(mixed, "band").select("a", "m").distinct(), "mixed")
    groups = components(rows.select(F.col("a").alias("node")).distinct(), rows.select("a", F.col("m").alias("b")))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    dealt = groups.join(sizes, "component").select(F.col("node").alias("a"), F.col("component").alias("group"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    own = buckets.groupBy("a").agg(F.min("component").alias("component"), F.collect_list("k").alias("ks"), F.collect_list("band").alias("bands"))
    full = dealt.join(own, "a").join(sketches, "a").join(sets.select(F.col("doc_id").alias("a"), "s"), "a")
    # block i meets every block j: its rows go to the tasks (min(i, j), max(i, j))
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", "parts")
    num, den = threshold.numerator, threshold.denominator
    return pairs.groupBy("group", "p", "q").applyInArrow(lambda t: _links_between(t, limit, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links) of every row.

    n_links: confirmed links that the search used for the document's class, at least one for each linked class. Null
    texts and texts without words have an empty set: they are linked with nothing. Texts of fewer than five words are
    one shingle. Equal sets have similarity 1. Rows of one doc_id are linked by their id. A row without doc_id is its own
    component, null, and is kept. An empty table gives no rows.
    """
    exact = Fraction(str(threshold))
    limit = sketch_limit(threshold)
    sig = materialise(signatures(docs), "signatures")
    named = sig.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("set_hash").agg(F.min("doc_id").alias("a"))
    heads = named.join(classes, "set_hash")
    members = heads.select("doc_id", "a").distinct()
    # bands travel without sketches, which are looked up for what shares a band
    buckets = materialise(heads.where("doc_id = a").dropDuplicates(["set_hash"]).select("a", F.posexplode("bands").alias("k", "band")), "bands")
    stars = buckets.groupBy("band").agg(F.min("a").alias("m"), F.count("*").alias("n")).where("n > 1").select("band", "m")
    shared = materialise(buckets.join(stars, "band"), "shared")
    met = shared.select("a").distinct()
    sketches = materialise(named.select(F.col("doc_id").alias("a"), "sketch").join(met, "a", "left_semi").distinct(), "sketches")
    # a document has at most BANDS rows on either side of a join by id; only the join by band may be skewed, and can be split
    least = shared.where("a = m").select("a", "band").join(sketches, "a").select("band", F.col("sketch").alias("ms"))
    near = shared.where("a != m").select("a", "m", "band").join(sketches, "a").join(least, "band")
    pairs = near.where(_xor_bits("sketch", "ms") <= limit).select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    sets = materialise(_sets_of(docs, met.withColumnRenamed("a", "_id")), "sets")
    links = materialise(_confirm(pairs, sets, exact), "links")
    same = members.where("doc_id != a").select(F.col("doc_id").alias("b"), "a")
    found = materialise(components(shared.select(F.col("a").alias("node")).distinct(), links), "components")
    labelled = materialise(shared.join(found.withColumnRenamed("node", "a"), "a").select("a", "k", "band", "component"), "labelled")
    links = materialise(links.unionByName(_cross_links(labelled, sketches, sets, limit, exact)), "links")
    every = components(members.select(F.col("doc_id").alias("node")).distinct(), links.union(same.select("a", "b")))
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    per = materialise(every.join(counts, "node", "left").select(F.col("node").alias("doc_id"), "component", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    out = sig.select("doc_id", "n_shingles").join(per, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    return shingle_sets(wanted)


def near_duplicate_filter(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id. Rows without doc_id, and rows
    that share one, are told apart by their texts and come last; of equal rows one stays. Texts without words stay."""

    def one_of_each(rows: DataFrame) -> DataFrame:
        gone = near_duplicates(rows, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
        left = rows.join(materialise(gone, "gone"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
        shared = F.coalesce(F.col("doc_id") >= SHARED_IDS, F.lit(False)) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        return left.where(~shared).unionByName(left.where(shared).dropDuplicates(["doc_id"]))

    return by_row(docs, one_of_each)
