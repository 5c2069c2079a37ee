"""Line dedup by pairwise alignment: shared rare lines find overlapping documents, a patience diff aligns them, and the
aligned common blocks go from the later document.

A line is known by a 128-bit hash of its bytes without outer white space. What can be deleted has ``min_words`` words or
more, so documents are looked up by windows: the shortest runs of lines, from each line on and up to each line, that have
that many words (a line of ``min_words`` words is a window of its own; blank lines are left out). Every line of every
common block lies in a common window, so windows find all there is to find.

A window that is in up to ``RARE`` rows is rare. A later document is aligned with every earlier one with which it shares
a rare window, by a patience diff over the lines of their common rare windows; aligned lines that follow on each other in
both documents are a block, and a block of ``min_words`` words or more goes. Rare windows give ``RARE - 1`` partners a row
at most. Windows in more rows than that are found by their counts alone: each stands in its smallest document and goes
from all others, in whatever order, without pairs. So no partner is left out and no group is expanded into pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import materialise, small_batches

#: Words that a run of aligned lines needs to be deleted.
MIN_WORDS = 10
#: Rows up to which a window is rare, and its documents are aligned pair by pair.
RARE = 8


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _filled(text: str) -> list[int]:
    """The places of the lines that have a word."""
    return [i for i, line in enumerate(_lines(text)) if line.strip()]


def _hash(line: str) -> bytes:
    return hashlib.blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=16).digest()


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs that have ``min_words`` words, from each line on and up to each line."""
    out: dict[tuple[int, int], None] = {}
    total = end = 0
    for first, n in enumerate(words):
        while end < len(words) and total < min_words:
            total, end = total + words[end], end + 1
        if total < min_words:
            break
        out[first, end - first] = None
        total -= n
    total = first = 0
    for last, n in enumerate(words):
        total += n
        while total - words[first] >= min_words:
            total, first = total - words[first], first + 1
        if total >= min_words:
            out[first, last + 1 - first] = None
    return list(out)


def line_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, line, size, at): where each different window of ``size`` lines begins, per row, in numbers of lines that have a word."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes, sizes, places = [], [], [], [], []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = [line for line in _lines(text or "") if line.strip()]
                lines = list(map(_hash, full))
                own: dict[tuple[bytes, int], list[int]] = defaultdict(list)
                for i, size in windows([len(line.split()) for line in full], min_words):
                    own[lines[i] if size == 1 else hashlib.blake2b(b"".join(lines[i : i + size]), digest_size=16).digest(), size].append(i)
                ids += [doc_id] * len(own)
                texts += [text_hash] * len(own)
                hashes += [h for h, _ in own]
                sizes += [size for _, size in own]
                places += map(sorted, own.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "line", "size", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, line binary, size int, at array<int>")


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (a, b), a rising already, in which b rises too (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = ends[k - 1] if k else -1
        tops[k : k + 1], ends[k : k + 1] = [b], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _lcs_row(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with b[:0], b[:1] ... b, by bits of one whole number."""
    places: dict = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for x in a:
        if u := v & places.get(x, 0):
            v = ((v + u) | (v - u)) & ones
    return [0, *accumulate(int(c == "0") for c in bin(v | 1 << len(b))[:2:-1])]


def longest_common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence (Hirschberg: space in proportion to the sequences)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        mid = (a0 + a1) // 2
        left, right = _lcs_row(a[a0:mid], b[b0:b1]), _lcs_row(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        both = [x + y for x, y in zip(left, right, strict=True)]
        if best := max(both):
            cut = b0 + both.index(best)
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences: equal ends first, then items unique on both sides as anchors, then between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
        anchors = _longest_rising([(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if na[x] == 1 and x in at])
        if not anchors:  # only repeated items are shared
            out += [(a0 + i, b0 + j) for i, j in longest_common(a[a0:a1], b[b0:b1])]
            continue
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def common_blocks(pairs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of aligned lines that follow on each other on both sides."""
    run: list[tuple[int, int]] = []
    for pair in pairs:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            yield run
            run = []
        run.append(pair)
    if run:
        yield run


def aligned_lines(text: str, rare: list[tuple[tuple[int, int], int, list[int], list[int]]], frequent: list[tuple[int, int, list[int]]], min_words: int) -> dict[int, int]:
    """Line of the later document -> earlier document in which the line's block stands too.

    rare: (earlier document and its text's hash, lines, where they begin there, here) of each common rare window;
    frequent: (smallest document, lines, where they begin here) of the other windows."""
    lines, filled = _lines(text), _filled(text)
    plain = [lines[i].strip() for i in filled]
    found: dict[int, int] = {}
    by: dict[tuple[int, int], list] = defaultdict(list)
    for earlier, size, there, here in rare:
        by[earlier].append((size, there, here))
    for earlier in sorted(by):
        a: dict[int, str] = {}
        b: dict[int, str] = {}
        for size, there, here in by[earlier]:
            for k in range(size):
                line = plain[here[0] + k]
                a.update((i + k, line) for i in there)
                b.update((j + k, line) for j in here)
        at, here = sorted(a), sorted(b)
        for block in common_blocks([(at[i], here[j]) for i, j in patience([a[i] for i in at], [b[j] for j in here])]):
            if sum(len(plain[j].split()) for _, j in block) >= min_words:
                for _, j in block:
                    found.setdefault(filled[j], earlier[0])
    for owner, size, here in sorted(frequent):
        for j in here:
            for k in range(size):
                found.setdefault(filled[j + k], owner)
    return found


def delete_blocks(text: str, aligned: dict[int, int], min_words: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without its runs of aligned lines of ``min_words`` or more; (first line, lines, words) of each run.

    Blank lines inside a run go with it."""
    lines = _lines(text)
    runs, run = [], []
    for i, line in enumerate([*lines, None]):
        if line is not None and (i in aligned or run and not line.strip()):
            run.append(i)
            continue
        while run and run[-1] not in aligned:
            run.pop()
        if run and (words := sum(len(lines[j].split()) for j in run)) >= min_words:
            runs.append((run[0], len(run), words))
        run = []
    gone = {j for first, n, _ in runs for j in range(first, first + n)}
    return "\n".join(x for j, x in enumerate(lines) if j not in gone), runs


OUT = "doc_id long, text string, n_lines int, deleted_lines int, deleted_words long, earlier array<long>, blocks array<struct<first:int,lines:int,words:long>>"


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """Each document with its text after deletion, and what was deleted: (first line, lines, words) and the documents aligned with.

    Null texts stay null, with no lines; empty texts have no lines either. Rows of one doc_id count as the same document:
    they don't delete from each other, and all are handled alike. A row without doc_id is returned as it is. Ties: the
    smallest doc_id is the earlier one. Very long texts cost by their lines. An empty table gives no rows. Further columns
    of ``docs`` come back unchanged; one called like a column of the result gives way to it.
    """
    found = line_windows(docs, min_words)
    # partial sums before the shuffle, so a window that many rows have is one row a task
    counts = found.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    counts = materialise(counts.drop("last"), "windows")
    # both sides come straight from their shuffles, so AQE splits a frequent window's rows
    held = materialise(found.join(counts, "line").where((F.col("n") <= rare) | (F.col("doc_id") > F.col("first"))), "held")
    frequent = held.where(F.col("n") > rare).select("doc_id", "text_hash", F.col("first").alias("earlier"), F.lit(None).cast("long").alias("earlier_hash"), "size", F.lit(None).cast("array<int>").alias("there"), "at")
    own = F.struct("doc_id", "text_hash", "size", "at")
    few = held.where(F.col("n") <= rare).groupBy("line").agg(F.collect_set(own).alias("rows"))  # ``rare`` rows at most
    pairs = few.select("rows", F.explode("rows").alias("d")).select("d", F.explode("rows").alias("e")).where("e.doc_id < d.doc_id")
    pairs = pairs.select("d.doc_id", "d.text_hash", F.col("e.doc_id").alias("earlier"), F.col("e.text_hash").alias("earlier_hash"), "d.size", F.col("e.at").alias("there"), "d.at")
    matches = pairs.unionByName(frequent).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("earlier", "earlier_hash", "size", "there", "at")).alias("m"))
    matches = materialise(matches.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "m"), "matches")
    return _apply(docs, matches, min_words)


def _apply(docs: DataFrame, matches: DataFrame, min_words: int) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    joined = keep.join(matches, (keep["doc_id"] == matches["_id"]) & (F.xxhash64(keep["text"]) == matches["_hash"]), "left").select("doc_id", "text", "m", "_rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rare = [((x["earlier"], x["earlier_hash"]), x["size"], x["there"], x["at"]) for x in m or () if x["there"] is not None]
                frequent = [(x["earlier"], x["size"], x["at"]) for x in m or () if x["there"] is None]
                aligned = aligned_lines(text, rare, frequent, min_words) if m and text else {}
                left, runs = delete_blocks(text, aligned, min_words) if aligned else (text, [])
                earlier = sorted({aligned[j] for first, n, _ in runs for j in range(first, first + n) if j in aligned})
                row = (left, len(_lines(text)) if text else 0, sum(n for _, n, _ in runs), sum(w for *_, w in runs), earlier, [dict(zip(("first", "lines", "words"), r, strict=True)) for r in runs])
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            block = pa.struct([("first", pa.int32()), ("lines", pa.int32()), ("words", pa.int64())])
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(block))
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(3)], names=["doc_id", "text", "n_lines", "deleted_lines", "deleted_words", "earlier", "blocks", "_rest"])

    full = StructType.fromDDL(OUT).add("_rest", joined.schema["_rest"].dataType)
    done = joined.mapInArrow(run, full)
    names = ["n_lines", "deleted_lines", "deleted_words", "earlier", "blocks"]
    return done.select("doc_id", "text", *[F.col(f"_rest.`{c}`") for c in rest if c not in names], *names)


def line_dedup_filter(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with aligned blocks deleted; documents of which nothing is left are dropped, those blank before stay."""
    done = line_dedup(docs, min_words)
    return done.where(~((F.col("deleted_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""))).select(*docs.columns)
