"""Very long texts, nulls in any column, ties and repeated rows for operators whose own tests leave them out."""

import hashlib

import pytest

from beamquarry.llm import chat, exact_dedup, line_dedup, quality, sharding, substring_dedup, url_filter

LONG = " ".join(f"w{i}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + " x"), (None, None), (None, LONG), (4, ""), (4, ""), (5, "tie"), (5, "tie"), (6, None)]
    return spark.createDataFrame([(i, t, "k", 7, b"b") for i, t in rows], "doc_id long, text string, digest string, keep_id int, group binary")


def test_exact_dedup_of_odd_rows(odd):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(odd, "largest").collect()), key=repr)
    want = [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (5, 5, 2, True), (5, 5, 2, True)]
    want += [(4, 6, 4, False), (4, 6, 4, False), (6, 6, 4, True), (None, 6, 4, False)]
    assert got == sorted(want, key=repr)
    digests = {r["text_sha256"] for r in exact_dedup.dedup(odd).collect()}
    assert digests == {hashlib.sha256(t.encode()).hexdigest() for t in (LONG, LONG + " x", "", "tie")}


@pytest.mark.parametrize("most", [16_000_000, 0])
def test_filter_never_rejects_a_hit(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_KEYS", most)
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('t', cast(id % 1500 AS string)) AS text")
    got = exact_dedup.dedup(df).collect()
    assert all((r["keep_id"], r["group_size"]) == (r["doc_id"] % 1500, 3 if r["doc_id"] % 1500 < 1000 else 2) for r in got)


def test_sharding_of_odd_rows(odd):
    out = sharding.assign(odd, shards=4).collect()
    assert len(out) == 10 and sum(r["size"] for r in out) == 4 * len(LONG) + 2 + 6 + 10
    for shard in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_substrings_of_odd_rows(odd):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd).collect()), key=repr)
    n = 60_000
    assert got == sorted([(1, n, 0), (2, n, n), (3, n + 1, n), (None, n, n), (None, 0, 0), (4, 0, 0), (4, 0, 0), (5, 1, 0), (5, 1, 0), (6, 0, 0)], key=repr)


def test_lines_and_rules_of_odd_rows(odd):
    assert line_dedup.aligned(odd).count() == 10
    assert {r["doc_id"] for r in quality.assess(odd).where("kept").collect()} == {1, 2, 3, None}


def test_chat_of_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (2, 5, "user", None)]
    out = {r["conv_id"]: r for r in chat.digests(chat.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in out.items()} == {None: (2, 0), 1: (2, 2 * len(LONG)), 2: (1, 0)}


def test_urls_of_odd_rows(spark):
    long = "http://a.example.org/" + "x" * 200_000
    rows = [(1, long), (1, long), (None, None), (2, "://"), (3, "no scheme"), (4, "x://WWW.Casino-Win.example.NET?q")]
    got = sorted(((r["page_id"], r["host"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=repr)
    assert got == sorted([(1, "a.example.org", "allow"), (1, "a.example.org", "allow"), (None, "", "allow"), (2, "", "allow"), (3, "", "allow"), (4, "www.casino-win.example.net", "block")], key=repr)
