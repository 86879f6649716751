"""Operator 3 with more sources than max_queues: each window holds each source's share, and weights count."""

from collections import defaultdict

import public_tokenizers
import pytest

from beamquarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_window(df, **kwargs):
    pieces = packing.pack(df, PATH, window=128, round_windows=3, **kwargs).collect()
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    out = defaultdict(lambda: defaultdict(int))
    for r in pieces:
        out[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    return sorted((r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"], r["source_queue"]) for r in pieces), out


@pytest.mark.parametrize("weights", [None, {f"s{i}": 1.0 + 4 * (i == 3) for i in range(12)}])
def test_windows_do_not_depend_on_max_queues(spark, weights):
    rows = [(100 * i + k, "word " * (600 if i == 0 else 40), f"s{i}") for i in range(12) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, windows = by_window(df, weights=weights)
    got, _ = by_window(df, weights=weights, max_queues=2)
    assert got == want
    total = {f"s{i}": 6 * (601 if i == 0 else 41) for i in range(12)}
    share = weights or total
    first = [windows[k] for k in range(5)]
    for w in first:
        assert sum(w.values()) == 128
        assert all(abs(w[s] - 128 * share[s] / sum(share.values())) <= 3 for s in share)


def test_more_sources_than_the_default(spark):
    rows = [(i, "some words here", f"s{i % 1500}") for i in range(3000)] + [(5000 + i, "hot " * 99, "hot") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, windows = by_window(df)
    total = 3000 * 4 + 60 * 100
    assert sum(sum(w.values()) for w in windows.values()) == total
    for k, w in windows.items():
        if k < max(windows):
            assert sum(w.values()) == 128 and abs(w["hot"] - 128 * 6000 / total) <= 4
