"""Operator 7: all blocks that an earlier document has go, at any count, in any order, repeated or short."""

import random

import numpy as np
import pytest

from beamquarry.llm import line_dedup

X, Y = "the first of two long lines", "the second of two long lines"


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def left(df, **kwargs):
    return {r["doc_id"]: r["text"] for r in line_dedup.aligned(df, **kwargs).collect()}


def brute(rows, min_chars):
    """Every run of lines of every document against every run of every earlier one."""
    first = {}
    lines = [(i, t.split("\n")) for i, t in rows]
    for i, x in lines:
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                first[tuple(x[a:b])] = min(i, first.get(tuple(x[a:b]), i))
    out = {}
    for i, x in lines:
        gone = set()
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                if sum(map(len, x[a:b])) >= min_chars and first[tuple(x[a:b])] < i:
                    gone |= set(range(a, b))
        out[i] = "\n".join(line for k, line in enumerate(x) if k not in gone)
    return out


@pytest.mark.parametrize("copies", [3, 64, 65, 300])
def test_a_block_goes_whole_at_any_count(spark, copies):
    text = "\n".join(["f" * 54, "g" * 105, "ten letter", "h" * 543])
    small = "one\ntwo words\n\nand three"
    rows = [(i, text) for i in range(copies)] + [(1000 + i, f"own line of {i}\n{small}") for i in range(copies)]
    got = left(texts(spark, rows))
    assert got[0] == text and got[1000] == rows[copies][1]
    assert all(got[i] == "" for i in range(1, copies))
    assert all(got[1000 + i] == f"own line of {i}" for i in range(1, copies))
    assert {r["doc_id"] for r in line_dedup.clean(texts(spark, rows)).collect()} == {0, *range(1000, 1000 + copies)}


def test_no_overlap_is_lost_that_is_not_in_the_first_holders_order(spark):
    got = left(texts(spark, [(1, f"{X}\n{Y}"), (2, f"{Y}\nshort\n{X}"), (3, f"{Y}\nshort\n{X}")]))
    assert got == {1: f"{X}\n{Y}", 2: "short", 3: ""}


def test_repeated_lines_go(spark):
    rows = [(1, f"pppp\n{X}\n{X}\nqqqq"), (2, f"rrrr\n{X}\n{X}\nssss"), (3, f"{X}\ntttt\n{X}\nqqqq")]
    assert left(texts(spark, rows)) == {1: rows[0][1], 2: "rrrr\nssss", 3: "tttt"}


def test_blocks_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["", "", "a", "bb", "ccc", "dddd", "eeeee", "f" * 8, "g" * 9, "h" * 12]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in rng.sample(range(500), 60)]
    df = texts(spark, rows)
    for min_chars in (8, 11):
        got = left(df, min_chars=min_chars)
        assert got == brute(rows, min_chars) == left(df, min_chars=min_chars, rare=1)
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)


def test_what_an_alignment_ties_goes(spark):
    rng = random.Random(5)
    pool = ["a", "bb", "", "c" * 9, "d" * 12, "e" * 12]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(8))) for i in range(12)]
    gone = {i: text.count("\n") + 1 for i, text in rows}
    for r in line_dedup.aligned(texts(spark, rows), min_chars=9).collect():
        gone[r["doc_id"]] = r["n_deleted"]
    for i, text in rows:
        tied = set()
        for _, earlier in rows[:i]:
            b = text.split("\n")
            tied |= set(line_dedup.common_blocks(earlier.split("\n"), b, [len(x) >= 9 for x in b]))
        assert len(tied) <= gone[i]


def test_blocks_are_few():
    for lengths in ([0] * 500 + [3] * 9 + [0] * 500, [30] * 40, [1] * 300, [], [5]):
        low, high = line_dedup.blocks_of(np.array(lengths, np.int64), 20)
        assert len(low) <= 2 * len(lengths)
        assert all(sum(lengths[a:b]) >= 20 for a, b in zip(low, high, strict=True))
