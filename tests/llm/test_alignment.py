"""Line dedup against all pairs of documents."""

import random

import pytest

from fenestra.llm import linededup

SF = "/root/testdata/sf0.001"


def runs(text, min_words):
    """Every minimal run of lines with enough words: (lines) -> first places, by looking at all runs."""
    full = [x.strip() for x in (text or "").split("\n") if x.strip()]
    size = [len(x.split()) for x in full]
    out = {}
    for i in range(len(full)):
        for j in range(i + 1, len(full) + 1):
            if sum(size[i:j]) >= min_words:
                forward = sum(size[i : j - 1]) < min_words
                backward = sum(size[i + 1 : j]) < min_words
                if forward or backward:
                    out.setdefault(tuple(full[i:j]), []).append(i)
                if not forward:
                    break
    for j in range(1, len(full) + 1):
        for i in range(j - 1, -1, -1):
            if sum(size[i:j]) >= min_words:
                at = out.setdefault(tuple(full[i:j]), [])
                if i not in at:
                    at.append(i)
                break
    return full, out


def brute(texts, min_words=linededup.MIN_WORDS, rare=linededup.RARE):
    """doc_id -> lines left that have a word; every pair of documents is aligned."""
    found = {i: runs(t, min_words) for i, t in texts.items()}
    holders = {}
    for i in sorted(found):
        for w in found[i][1]:
            holders.setdefault(w, []).append(i)
    left = {}
    for d, (full, own) in found.items():
        gone = set()
        for e in (e for e in found if e < d):
            both = [w for w in own if w in found[e][1] and len(holders[w]) <= rare]
            mine = sorted({i + k for w in both for i in own[w] for k in range(len(w))})
            other = sorted({i + k for w in both for i in found[e][1][w] for k in range(len(w))})
            pairs = [(other[i], mine[j]) for i, j in linededup.patience([found[e][0][i] for i in other], [full[j] for j in mine])]
            for start in range(len(pairs)):
                if start and pairs[start] == (pairs[start - 1][0] + 1, pairs[start - 1][1] + 1):
                    continue
                end = start + 1
                while end < len(pairs) and pairs[end] == (pairs[end - 1][0] + 1, pairs[end - 1][1] + 1):
                    end += 1
                lines = [j for _, j in pairs[start:end]]
                if sum(len(full[j].split()) for j in lines) >= min_words:
                    gone.update(lines)
        for w, at in own.items():
            if len(holders[w]) > rare and holders[w][0] < d:
                gone.update(i + k for i in at for k in range(len(w)))
        left[d] = [x for j, x in enumerate(full) if j not in gone]
    return left


def kept_lines(rows):
    return {r["doc_id"]: [x.strip() for x in (r["text"] or "").split("\n") if x.strip()] for r in rows}


def test_op6_equals_all_pairs_on_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = linededup.line_dedup(docs).collect()
    assert kept_lines(got) == brute(texts)
    assert sum(r["deleted_lines"] for r in got) > 0


@pytest.mark.parametrize("rare", [2, 8])
def test_line_dedup_equals_all_pairs_on_shuffled_blocks(docs_of, rare):
    rng = random.Random(rare)
    short = [" ".join(f"s{rng.randrange(99)}" for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    long = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(10, 15))) for _ in range(12)]
    blocks = [[rng.choice(short + long) for _ in range(rng.randrange(1, 6))] for _ in range(14)]
    texts = {}
    for i in range(60):
        lines = [x for _ in range(rng.randrange(1, 5)) for x in [*rng.choice(blocks), f"own {rng.randrange(30)}"]]
        texts[100 - i] = "\n".join(x for line in lines for x in ([line, ""] if rng.random() < 0.2 else [line]))
    got = linededup.line_dedup(docs_of(list(texts.items())), rare=rare).collect()
    assert kept_lines(got) == brute(texts, rare=rare)


def test_lines_of_two_documents_are_no_block(docs_of):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, f"{x}\nfirst"), (2, f"{y}\nsecond"), (3, f"{x}\n{y}"), (4, f"{x}\nbetween\n{y}"), (5, f"new\n{x}\n\n{y}")]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert got[3] == f"{x}\n{y}"  # no earlier document has both lines
    assert got[4] == f"{x}\nbetween\n{y}"  # nor do they follow on each other there
    assert got[5] == "new"


def test_copy_of_a_document_whose_lines_an_earlier_one_has_in_another_order(docs_of):
    lines = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdefgh"]
    rows = [(1, "\n".join(reversed(lines))), (2, "\n".join(lines)), (3, "\n".join(lines))]
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert got[3]["text"] == "" and 2 in got[3]["earlier"] and got[2]["deleted_lines"] == 1


def test_a_window_of_very_many_rows_and_a_very_long_text(docs_of):
    notice = " ".join(f"n{i}" for i in range(60))
    rows = [(i, f"{notice}\nown {i}" if i % 2 else f"own {i}\nand {i}\n{notice}") for i in range(300)]
    long = "\n".join(" ".join(f"l{k}x{i}" for i in range(12)) for k in range(5000))
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs_of([*rows, (900, long), (901, f"{long}\nrest")])).collect()}
    assert got[0] == rows[0][1] and got[1] == "own 1" and got[298] == "own 298\nand 298" and got[900] == long and got[901] == "rest"
