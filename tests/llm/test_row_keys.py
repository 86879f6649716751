"""Null and repeated doc_ids through the near-duplicate stage, the mix and what is taken by it."""

import re
from collections import Counter, defaultdict

import pytest

from beamquarry.llm import mixing, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(WORD.findall(text or ""))


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(f"w{i}x{k}" for k in range(20 + i)), "en", "abc"[i % 3], i) for i in range(30)]
    out += [(None, " ".join(f"n{j}x{k}" for k in range(15)), None, "abc"[j % 3], j) for j in range(9)]
    out += [(None, "no id and the same text", None, "b", 1)] * 4
    out += [(7, "seven again " * 9, "de", "b", j) for j in range(5)] + [(8, "another source", "de", "c", 1), (8, "another source", "de", None, 1)]
    return out


def test_taken_words_reach_each_source_with_null_and_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix(df)
    want, got = defaultdict(int), defaultdict(int)
    for r in taken.collect():
        want[r["source_size"]] += r["taken"]
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += words(r[1])
    assert len(set(size.values())) == len(size)
    out = mixing.apply_mix(df, taken)
    assert out.columns == df.columns
    for r in out.collect():
        got[size[r["source"]]] += words(r["text"])
    assert got == {k: v for k, v in want.items() if v}
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[None] > 0 and ids[7] <= 3 * 6


def test_parts_of_equal_rows_are_those_of_the_mix(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for share in (0.3, 0.77, 1.0):
        taken = mixing.mix(df, share=share)
        full, part = Counter(), Counter()
        for r in taken.collect():
            full[r["doc_id"]] += r["taken"] // r["size"]
            part[r["doc_id"], r["taken"] % r["size"]] += r["taken"] % r["size"] > 0
        sizes = {(r[0], words(r[1])) for r in rows}
        for r in mixing.apply_mix(df, taken).collect():
            n = words(r["text"])
            if (r["doc_id"], n) in sizes:
                full[r["doc_id"]] -= 1
            else:
                part[r["doc_id"], n] -= 1
        assert not any(full.values()) and not any(part.values())


def test_one_row_of_a_shared_doc_id(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = ngram_join.one_per_component(df)
    assert out.columns == df.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[None] == 13
    assert all(n == 1 for i, n in ids.items() if i is not None)
    assert set(ids) == {None, *range(30)}
