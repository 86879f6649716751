"""Operator 7's alignment: an exact diff in gaps, moved and repeated pieces by themselves, one partner for a neighbourhood that thousands share."""

import random
import time

from beamquarry.llm import line_dedup


def longest(a, b):
    """Length of the longest common subsequence by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_exact_diff_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 10))] for _ in range(2))
        ties = line_dedup.exact(a, b, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in ties) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(ties, ties[1:], strict=False))
        assert len(ties) == longest(a, b)


def test_gaps_without_unique_lines_are_aligned():
    a, b = list("axbxyxxc"), list("apxxqxxc")  # between a and c no line is unique in both
    ties = line_dedup.patience(a, b)
    assert [a[i] for i, _ in ties] == list("axxxc") or len(ties) == longest(a, b)


def test_every_shared_entry_is_aligned_once():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.sample(range(30), rng.randint(0, 20))
        b = [rng.choice(range(30)) for _ in range(rng.randint(0, 30))]
        found = list(line_dedup.alignments(a, b))
        tied = [t for ties in found for t in ties]
        assert sorted(j for _, j in tied) == [j for j, x in enumerate(b) if x in a]
        assert all(a[i] == b[j] for i, j in tied)
        for ties in found:
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(ties, ties[1:], strict=False))


def test_order_costs_little():
    """Reversed, repeated and shuffled documents of 20,000 entries."""
    n = 20_000
    a = list(range(n))
    shuffled = random.Random(4).sample(a, n)
    begun = time.perf_counter()
    for b in (a[::-1], [7] * n, a[n // 2 :] + a[: n // 2], shuffled, a):
        assert sum(map(len, line_dedup.alignments(a, b))) == n
    assert time.perf_counter() - begun < 30
    assert len(list(line_dedup.alignments(a, a[n // 2 :] + a[: n // 2]))) == 2  # a moved half is one piece


def test_one_pair_for_each_document_of_a_common_line(spark, monkeypatch):
    """A line in 3,000 documents: each is paired with the first holder alone."""
    rows = [(i, f"the line that is everywhere at all\nown words of number {i} here") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.selectExpr("doc_id", "xxhash64(text) AS sign", "text")
    blocks = line_dedup.block_table(docs, 20)
    assert blocks.count() == 2 * len(rows)
    out = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.aligned(df).collect()}
    assert out.pop(0) == (0, rows[0][1])
    assert all(v == (1, f"own words of number {i} here") for i, v in out.items())


def test_lines_of_a_pair():
    x, y, z = 11, 22, 33
    shared = [{"first": 1, "place": p, "h": h, "low": low, "high": low + 1} for p, h, low in ((0, x, 5), (4, y, 2), (4, y, 3), (2, z, 0))]
    assert line_dedup.aligned_lines(shared).tolist() == [True, False, True, True, False, True]
