"""Operator 4 against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from beamquarry.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(10**6)}"][: rng.randint(0, 1)]
        yield " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_join_finds_every_link(spark, k, percent):
    rng = random.Random(k)
    texts = [None, "", " \n", "One", "one", "one two", "ONE two", "one two three four", "x " * 50]
    for size in (1, 2, 4, 6, 9, 12, 18, 20, 21, 25, 33, 60, 150, 400):
        for _ in range(2):
            texts += family(rng, size, 7, max(1, size * (100 - percent) // 60))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, k, percent).collect()}
    want = brute(rows, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)
    kept = nj.one_per_component(df, k, percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_join_on_corpus(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, 3, 90).collect()} == brute(rows, 3, 90)


def test_empty(spark):
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_lists_keep_every_partner(percent):
    """Random pairs at or above the threshold share a list that both stay in, however long the lists are; small ones a subset."""
    rng = np.random.default_rng(5)

    def stays(elements, length):
        first = elements[: nj.prefix_length(len(elements), percent)]
        by_length = sorted(first.tolist(), key=lambda x: (length(x), x))
        return set(by_length[: max(0, len(first) - nj.dropped(len(elements), percent))])

    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        new = int(rng.integers(0, n * (100 - percent) // 100 + 2))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < percent * (len(a) + len(b) - common):
            continue
        met += 1
        salt = int(rng.integers(1, 2**31))
        assert stays(a, lambda x, s=salt: x * s % 7) & stays(b, lambda x, s=salt: x * s % 7)
        if max(len(a), len(b)) <= nj.SMALL:
            assert len(np.intersect1d(nj.subset_keys(a, percent), nj.subset_keys(b, percent)))
        bits = sum(bin(x).count("1") for x in (nj.sketch_of(a) ^ nj.sketch_of(b)).view(np.uint64).tolist())
        assert bits * (100 + percent) <= (100 - percent) * (len(a) + len(b))
    assert met > 500


def test_links_in_blocks_of_long_lists(spark, monkeypatch):
    """Chains whose ends are too far apart for one hub, with lists cut into blocks of three."""
    monkeypatch.setattr(nj, "BLOCK", 3)
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(70):
        words = list(words)
        for _ in range(rng.choice((1, 2, 3))):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, 1, 90).collect()} == brute(rows, 1, 90)


def crowd(rng, count, shared, own):
    """Texts with a passage in common and words of their own: all alike to the same degree, below the threshold."""
    passage = " ".join(f"p{i}" for i in range(shared))
    for _ in range(count):
        yield " ".join([passage, *(f"o{rng.randrange(10**12)}" for _ in range(own))])


@pytest.mark.parametrize(("shared", "own"), [(60, 40), (80, 60), (85, 15)])
def test_crowds_that_only_share_a_passage_make_no_pairs(spark, shared, own):
    """Lists that may yield pairs hold no more of them when the crowd doubles; the links in and beside the crowd are found."""
    met = []
    for count in (300, 600):
        rng = random.Random(count)
        rows = list(enumerate(crowd(rng, count, shared, own)))
        for i in range(0, 40, 2):
            rows.append((1000 + i, rows[i][1].rsplit(" ", 1)[0] + " end"))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        signs = nj.stored(nj.signed(df, 1, 80), "test-signs")
        found = nj.members(df, signs, 1, 80)
        led = found.groupBy("key").agg({"leads": "max", "node": "count"}).where("`max(leads)`").collect()
        met.append(sum(r["count(node)"] ** 2 for r in led))
        if count == 300:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, 1, 80).collect()}
            assert got == brute(rows, 1, 80)
            assert len({c for _, c in got.values()}) == count
    assert met[1] <= 1.5 * met[0] + 100


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_rarest_elements_keep_every_partner(spark, monkeypatch, percent):
    """With every list heavy, all links come from rarest elements, where the smaller set leads."""
    monkeypatch.setattr(nj, "HEAVY", 1)
    rng = random.Random(percent)
    texts = []
    for size in (1, 3, 8, 13, 30, 90):
        for _ in range(3):
            texts += family(rng, size, 9, max(1, size * (100 - percent) // 50))
    texts += crowd(rng, 20, 50, 9)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, 2, percent).collect()} == brute(rows, 2, percent)


@pytest.mark.parametrize("bits", [1, 6, 20])
def test_any_number_of_counters_keeps_every_partner(spark, monkeypatch, bits):
    """Elements that share counters are ranked together, and no link is lost."""
    monkeypatch.setattr(nj, "HEAVY", 1)
    monkeypatch.setattr(nj, "COUNTER_BITS", bits)
    rng = random.Random(bits)
    texts = [t for size in (5, 14, 40) for _ in range(3) for t in family(rng, size, 8, max(1, size // 8))] + list(crowd(rng, 20, 50, 9))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df, 1, 80).collect()} == brute(rows, 1, 80)


def test_sets_of_heavy_lists_are_not_opened_whole(spark):
    """Of 200 near copies of 300 words each is listed under the elements that it needs, a fifth; nothing makes a row of each element."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:-20], *(f"x{rng.randrange(10**9)}" for _ in range(20))])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signs = nj.stored(nj.signed(df, 1, 80), "test-signs")
    rare, held = nj.rarest(df, signs, signs.select("node"), 1, 80, 20)
    found = rare.groupBy("node").count().collect()
    assert len(found) == 200 and max(r["count"] for r in found) <= 61 - 18
    assert "Generate" not in rare._jdf.queryExecution().executedPlan().toString()
    assert held.count() == 200


def test_a_pair_shares_a_list_that_its_smaller_set_leads():
    rng, met = random.Random(3), 0
    for percent in (60, 80, 90):
        for _ in range(4000):
            n = rng.randint(1, 120)
            a = set(range(n))
            b = set(rng.sample(range(n), n - rng.randint(0, n * (100 - percent) // 100))) | set(range(500, 500 + rng.randint(0, n * (100 - percent) // 100 + 1)))
            if 100 * len(a & b) < percent * len(a | b) or not a & b:
                continue
            met += 1
            order = {e: rng.random() for e in a | b}
            x, y = sorted((sorted(s, key=order.get) for s in (a, b)), key=len)
            leading = x[: len(x) - nj.equal_share(len(x), percent) + 1]
            assert set(leading) & set(y[: len(y) - nj.least(len(y), percent) + 1])
            if len(x) == len(y):
                assert set(leading) & set(y[: len(y) - nj.equal_share(len(y), percent) + 1])
    assert met > 1000


def test_rows_of_one_doc_id_are_apart(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, "another text"), (None, long), (None, "alone here"), (3, "another text"), (9, None), (7, " ".join(f"v{i}" for i in range(20_000)))]
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, 36, 5), (5, 1, 3), (None, 36, 5), (None, 1, None), (3, 1, 3), (9, 0, 9), (7, 19_996, 7)], key=str)
