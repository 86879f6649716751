"""Operator 1: what is taken from which document, against plain loops over the same draws."""

import math
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from beamquarry.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seats_by_highest_quotient(weights, seats):
    """One seat at a time, to the highest weight / (2k + 1); ties to the first key."""
    won = dict.fromkeys(weights, 0)
    for _ in range(seats if any(weights.values()) else 0):
        best = max(sorted(weights), key=lambda k: Fraction(weights[k]) / (2 * won[k] + 1))
        won[best] += 1
    return won


@pytest.mark.parametrize("share", [0.4, 1.0])
def test_taken_words_of_each_document(spark, monkeypatch, share):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.mix(docs, share=share).collect()}
    draws = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(17), "doc_id").alias("draw"), F.xxhash64(F.lit(18), "doc_id").alias("deal")).collect()
    assert len(got) == len(draws)
    by = defaultdict(list)
    for r in draws:
        by[r["source"]].append((r["draw"], r["doc_id"], len(WORD.findall(r["text"] or "")), r["deal"]))
    size = {s: sum(x[2] for x in rows) for s, rows in by.items()}
    target = {s: got[rows[0][1]]["target"] for s, rows in by.items()}
    blocks = seats_by_highest_quotient({f"a{s}": target[s] for s in by}, round(sum(size.values()) * share / 8))
    for source, rows in by.items():
        count = max(1, math.ceil(len(rows) / 40))
        shards = defaultdict(list)
        for row in sorted(rows):
            shards[row[3] % count].append(row)
        weights = {k: sum(x[2] for x in v) for k, v in shards.items()}
        quota = seats_by_highest_quotient(weights, blocks[f"a{source}"])
        for k, members in shards.items():
            words = 8 * quota[k]
            passes = min(3, words // weights[k]) if weights[k] else 0
            left = words - passes * weights[k] if passes < 3 else 0
            for _, doc_id, n, _ in members:
                part = max(0, min(n, left))
                left -= part
                assert (got[doc_id]["size"], got[doc_id]["taken"]) == (n, passes * n + part)
