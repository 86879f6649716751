"""Operator 3 against a direct tokenisation, an exact cover and the target proportions."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beamquarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(df, pieces, window):
    tokenizer = Tokenizer.from_file(PATH)
    want = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in df.collect()]
    by, windows = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        by[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    assert set(by) == {k for k, _ in want}
    copies = defaultdict(list)
    for k, ids in want:
        copies[k].append(ids)
    for k, texts in copies.items():
        if len(texts) > 1:
            assert sum(r["length"] for r in by[k]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(texts[0]))
            part = np.array(texts[0][at : at + r["length"]], "<u4").tobytes()
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(part)
            at += r["length"]
        assert at == len(texts[0])
    for k, rows in windows.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    return windows


def test_pack_covers_all_and_holds_proportions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    windows = check(df, packing.pack(df, PATH, round_windows=4), 2048)
    total = defaultdict(int)
    for rows in windows.values():
        for r in rows:
            total[r["source_queue"]] += r["length"]
    whole = sum(total.values())
    for k, rows in windows.items():
        if k < max(windows):
            got = defaultdict(int)
            for r in rows:
                got[r["source_queue"]] += r["length"]
            assert all(abs(got[q] - 2048 * n / whole) <= 3 for q, n in total.items())


def test_pack_odd_rows(spark):
    rows = [
        (1, None, None, "clash"), (2, "", "a", None), (3, "Hello<|endoftext|> WORLD é \x1c x's\x85y", "a", None), (4, "word " * 9000, "b", None),
        (5, "same", "c", None), (5, "same", "c", None), (6, " \t\n", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, queue string")
    for kwargs in ({}, {"weights": {"a": 1.0, "b": 5.0, None: 1.0}}, {"max_queues": 2}):
        check(df, packing.pack(df, PATH, window=64, round_windows=3, **kwargs), 64)
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("weights", [None, [5.0, 1.0, 1.0, 0.0, 2.0]])
def test_service_is_whole_and_monotone(weights):
    service = packing.Service([1000, 20, 0, 3, 977], weights)
    packed = np.arange(0, 2001)
    served = service.at(packed)
    assert (served.sum(axis=1) == packed).all()
    assert (served <= service.n).all() and (served[-1] == service.n).all()
    assert (np.abs(served - service.ideal(packed)) <= 1.5).all()
    coarse = service.at(packed[::50])
    assert (np.diff(coarse, axis=0) >= 0).all()


def test_deficit_round_robin_carries():
    plan = packing.deficit_round_robin(np.array([1000, 500, 7]), np.array([2.0, 1.0, 0.014]), np.zeros(3), 64)
    assert plan.sum() == 1507 and (plan.sum(axis=1)[:-1] == 64).all()
    share = np.cumsum(plan, axis=0)[:10] - np.arange(1, 11)[:, None] * 64 * np.array([2.0, 1.0, 0.014]) / 3.014
    assert (np.abs(share) < 2).all()


def test_another_vocabulary_is_used_whole():
    """A vocabulary that keeps case and white space has ids of its own rules."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two words,  it's 12 o'clock!\n\tIndented Line", "", None, "caf\u00e9 \u65e5\u672c <|x|> END", " lead and trail "]
    words, direct = packing.PieceIds(path), Tokenizer.from_file(path)
    got = [np.frombuffer(x, words.kind).tolist() for x in words.of(texts, 1)]
    assert got == [[*direct.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert not words.fast and packing.PieceIds(PATH).fast


def test_fast_way_takes_exactly_the_common_texts():
    """ASCII texts are told without the pattern, and pieces are those of the vocabulary's own rule in its own order."""
    import random
    import re

    from beamquarry.llm import packing

    rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t\n\r\f\va-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["'", "'s", "'re", "'l", "a", "Z", "7", " ", "\n", "\x1c", "<", "|", "<|", "!", "\u00e9", "\u00d7", "\x00", "\x7f"]) for _ in range(rng.randint(0, 9)))
        assert packing.common(text) == (not packing.UNCOMMON.search(text))
        assert packing.PIECE.findall(text.lower()) == rule.findall(text.lower())
