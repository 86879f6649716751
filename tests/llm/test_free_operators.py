"""Operators 7, 9 and 10 against brute force and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from beamquarry.llm import line_dedup, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- line dedup

A = [f"line number {i} of the first text" for i in range(12)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_patience_aligns_moved_and_repeated_lines():
    assert line_dedup.patience(["a", "b", "c"], ["x", "a", "b", "c", "y"]) == [(0, 1), (1, 2), (2, 3)]
    assert line_dedup.patience(["}", "f", "}"], ["}", "g", "}"]) == [(0, 0), (2, 2)]
    assert line_dedup.patience([], ["a"]) == line_dedup.patience(["a"], []) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_rising_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        js = rng.sample(range(12), rng.randint(0, 8))
        best = 0
        for mask in range(1 << len(js)):
            part = [j for k, j in enumerate(js) if mask >> k & 1]
            best = max(best, len(part)) if part == sorted(part) else best
        assert len(line_dedup.rising(list(enumerate(js)))) == best


@pytest.mark.parametrize("rare", [64, 1])
def test_shared_blocks_leave_the_later_document(spark, rare):
    rows = [
        (5, "\n".join(A), "clash"), (9, "\n".join(["its own beginning is here", *A[3:7], "", "ok", "its own end is right here"]), None), (7, None, None), (8, "", None),
        (12, "\n".join(A), None), (13, "a fresh line that nobody else has\nshort\n\nshort", None), (14, "short\nanother fresh line of this one", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = by_id(line_dedup.aligned(df, rare=rare))
    assert out[5]["text"] == rows[0][1] and out[5]["n_deleted"] == 0
    assert out[9]["text"] == "its own beginning is here\n\nok\nits own end is right here"
    assert (out[7]["text"], out[7]["n_lines"]) == (None, 0)
    assert (out[12]["text"], out[12]["n_deleted"]) == ("", 12)
    assert out[13]["text"] == rows[5][1] and out[14]["text"] == rows[6][1]
    kept = line_dedup.clean(df, rare=rare)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {5, 9, 7, 8, 13, 14}
    assert by_id(kept)[5]["n_lines"] == "clash"
    assert line_dedup.aligned(df.limit(0)).count() == 0


def test_no_seed_line_survives_twice_on_corpus(spark, sf_dir):
    """Rare or frequent: a long line that the first holder keeps is gone from the later ones (unless alignment crosses)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = by_id(line_dedup.aligned(df, rare=8))
    first, crossing, gone = {}, 0, 0
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        left = Counter(out[r["doc_id"]]["text"].split("\n"))
        for line in set(r["text"].split("\n")):
            if len(line) >= 20:
                if line in first:
                    crossing += left[line] > 0
                    gone += left[line] == 0
                else:
                    assert left[line]
                    first[line] = r["doc_id"]
    assert gone > 50 and crossing <= gone / 20


# --- sharding


@pytest.mark.parametrize("hot", [0, 700])
def test_shards_are_even(spark, hot):
    rng = random.Random(3)
    texts = [None, "", ""] + [" ".join("w" * rng.randint(1, 9) for _ in range(int(rng.paretovariate(1.2) * 20) % 900)) for _ in range(1400)]
    texts += ["the hot text of very many rows"] * hot
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, size int, shard int")
    out = sharding.assign(df, shards=16).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    by = defaultdict(list)
    for r in out:
        octets = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(octets) + 1, zlib.crc32(octets))
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(16))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total = sum(r["size"] for r in out)
    assert max(sum(r["size"] for r in rows) for rows in by.values()) <= 1.03 * total / 16
    assert max(len(rows) for rows in by.values()) <= 1.25 * len(out) / 16
    places = defaultdict(set)
    for r in out:
        places[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in places.items() if t is None or "hot" not in t)
    assert out == sharding.assign(df, shards=16).collect() or sorted(map(tuple, out)) == sorted(map(tuple, sharding.assign(df, shards=16).collect()))


def placed_by_rule(sizes, shards):
    """The placement rule in plain loops."""
    total = [sum(x[d] for x in sizes) / shards or 1e-300 for d in range(3)]
    need = [[x[d] / total[d] for d in range(3)] for x in sizes]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(need)), key=lambda i: -max(need[i])):
        roomy = [s for s in range(shards) if all(left[s][d] >= need[i][d] for d in range(3))]
        if roomy:
            score = {s: sum(w * left[s][d] * need[i][d] for d, w in enumerate((1, 8, 1))) for s in roomy}
        else:
            score = {s: sum(w * (left[s][d] - need[i][d]) for d, w in enumerate((1, 8, 1))) for s in range(shards)}
        out[i] = max(score, key=lambda s: (round(score[s], 9), -s))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], need[i], strict=True)]
    return out


def test_items_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 300):
        sizes = np.stack([rng.integers(1, 9, n), rng.pareto(1.5, n) * 500 + 1, rng.pareto(1.5, n) * 90], axis=1)
        got = sharding.pack_items(sizes, 16)
        assert got.tolist() == placed_by_rule(sizes.tolist(), 16)


def test_shards_of_the_corpus_are_near_equal(spark):
    out = sharding.assign(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shards=16)
    rows = out.groupBy("shard").agg({"size": "sum", "tokens": "sum", "doc_id": "count"}).collect()
    for column, slack in (("sum(size)", 0.01), ("sum(tokens)", 0.05), ("count(doc_id)", 0.05)):
        loads = [r[column] for r in rows]
        assert max(loads) <= (1 + slack) * sum(loads) / 16 and min(loads) >= (1 - slack) * sum(loads) / 16


def test_sharding_empty(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- substring dedup


def brute_repeats(rows, window):
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for a in range(len(words) - window + 1):
            k = tuple(words[a : a + window])
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = {a + j for a in range(len(words) - window + 1) if first[tuple(words[a : a + window])] < i for j in range(window)}
        out[i] = (len(words), len(gone), " ".join(w for a, w in enumerate(words) if a not in gone))
    return out


def corpus(rng):
    passages = [[f"p{rng.randrange(500)}" for _ in range(rng.choice((33, 49, 50, 51, 70, 130)))] for _ in range(9)]
    rows = [(900, None), (901, ""), (902, "x " * 300), (903, "x " * 90), (904, " \t\n"), (905, "x y " * 70), (3, "x " * 49)]
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                words += rng.choice(passages)
        rows.append((10 + i, rng.choice((" ", "\n", " \x0b")).join(words)))
    return rows


@pytest.mark.parametrize(("window", "memory_rows"), [(50, 500_000), (50, 40), (33, 700)])
def test_repeats_match_brute_force(spark, window, memory_rows):
    rows = corpus(random.Random(window))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    out = substring_dedup.remove_repeats(df, window, memory_rows).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == brute_repeats(rows, window)
    assert any(r["n_removed"] for r in out)


def test_repeats_with_few_busy_nodes(spark, monkeypatch):
    """Too frequent prefixes whose nodes are told by value and by a join."""
    monkeypatch.setattr(substring_dedup, "HOT_NODES", 40)
    rows = corpus(random.Random(1)) + [(2000 + i, "x " * 70) for i in range(30)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, 80).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == brute_repeats(rows, 50)


def test_repeats_on_corpus(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup.remove_repeats(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()], 50)


def test_repeats_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_subtree_depths_by_brute_force():
    rng = np.random.default_rng(6)
    for window in (32, 33, 50):
        base = rng.integers(1, 4, 300)
        parts = [base[a : a + n] for a, n in zip(rng.integers(0, 150, 30), rng.integers(window, 140, 30), strict=True)]
        codes = np.concatenate(parts).astype(np.uint64)
        begin = np.cumsum([0, *map(len, parts)])[:-1]
        starts = np.concatenate([b + np.arange(len(x) - window + 1) for b, x in zip(begin, parts, strict=True)])
        tree = substring_dedup.Subtree(codes, starts, window)
        whole = [tuple(codes[a : a + window]) for a in tree.suffixes]
        assert whole == sorted(tuple(codes[a : a + window]) for a in starts)
        for depth, x, y in zip(tree.depths[1:], whole, whole[1:], strict=False):
            common = next((k for k in range(window) if x[k] != y[k]), window)
            assert depth == common
        assert len(set(tree.deep_nodes().tolist())) == len(set(whole))


def test_deep_leaves():
    """Of nodes with leaves in several documents, those of all but the first."""
    words = [np.arange(40, dtype=np.uint64), np.arange(41, dtype=np.uint64), np.arange(5, 45, dtype=np.uint64), np.arange(900, 940, dtype=np.uint64)]
    got = substring_dedup.deep_leaves(np.array([4, 2, 2, 3]), np.array([1, 1, 1, 1]), np.array([0, 7, 60, 0]), [x.tobytes() for x in words], 40)
    assert [x.tolist() for x in got] == [[4], [1], [0]]
