"""Exact deduplication with a log-structured merge index over text digests.

Writing: each input task is a memtable that is flushed as one run, sorted by digest. Compaction merges the runs in
digest order (the shuffle sorts them, and neighbours are folded as they stream by) into a level that keeps
one identifier and a count for each digest; digests that occur once are dropped from it, so a level holds hits only. A level has a
Bloom filter. Reading: rows of the runs, and texts, are probed with the filter first; what it rejects is in no
group and goes on without a join. The bytes of all texts of a hit are compared (smallest
text = largest text), so equal digests alone never decide.

Defined cases: null text counts as empty; repeated rows are copies of each other, and where
rows share text and doc_id they are kept or dropped alike; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.bloom import Bloom
from beamquarry.llm.common import bounded_broadcast, stored

#: A digest that holds more than one in HOT_SHARE rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: The filter's rate of false positives, and the most keys for which it is made: 20 MB. Beyond, everything is probed by the join.
RATE, MOST_KEYS = 0.01, 16_000_000


def body(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(body(text), 256))


def flush(docs: DataFrame) -> DataFrame:
    """Runs of (digest, doc_id), one sorted file for each task, without a shuffle."""
    runs = docs.select(digest(F.col("text")).alias("digest"), "doc_id")
    return stored(runs.sortWithinPartitions("digest", "doc_id"), "lsm-run")


def level_of(runs: DataFrame) -> DataFrame:
    """Runs as a level: every entry stands for itself."""
    return runs.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))


def compact(*levels: DataFrame, keep: str = "smallest") -> DataFrame:
    """Merge levels of (digest, keep_id, group_size); `keep` is the "smallest" or "largest" identifier."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    merged = levels[0]
    for level in levels[1:]:
        merged = merged.unionByName(level)
    return merged.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def filter_of(level: DataFrame) -> Callable[[Column], Column] | None:
    """The level's Bloom filter, as an expression that tells whether a digest may be in it; None if it would be too large."""
    keys = level.count()
    return None if keys > MOST_KEYS else Bloom.sized(1, max(1, keys), RATE).build(level.select(F.col("digest").alias("key"))).accepts


def verify(docs: DataFrame, hits: DataFrame, may_hit: Callable[[Column], Column] | None = None) -> DataFrame:
    """(digest, same): whether a hit's texts are the same bytes.

    Texts that the level's filter rejects stay where they are (without a filter, those that a join rejects). Of the others each task
    sends one smallest and one largest text for a digest, so the copies of a hot text don't meet.
    """
    texts = docs.select(digest(F.col("text")).alias("digest"), body(F.col("text")).alias("_bytes"))
    if may_hit is None:
        texts = texts.join(bounded_broadcast(hits.select("digest"), hits), "digest", "left_semi")
    else:
        texts = texts.where(may_hit(F.col("digest")))
    return texts.groupBy("digest").agg((F.min("_bytes") == F.max("_bytes")).alias("same"))


def dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = flush(docs)
    level = stored(compact(level_of(runs), keep=keep).where("group_size > 1"), "lsm-level")
    may_hit = filter_of(level)
    hits = stored(level.join(verify(docs, level, may_hit), "digest"), "lsm-hits")
    if hits.where("NOT same").limit(1).count():
        return by_bytes(docs, keep)
    least = max(2, runs.count() // HOT_SHARE)
    hot = hits.where(F.col("group_size") >= least).select("digest", F.col("keep_id").alias("_hot_id"), F.col("group_size").alias("_hot_n"))
    cold = hits.where(F.col("group_size") < least).select(F.col("digest").alias("_key"), "keep_id", "group_size")
    # rows of hot digests are done after the first join; for the second they get keys of their own and spread
    own = F.unhex(F.sha1(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    probed = runs.withColumn("_may", may_hit(F.col("digest")) if may_hit else F.lit(True))
    found = (
        probed.where("_may").join(F.broadcast(hot), "digest", "left")
        .withColumn("_key", F.when(F.col("_hot_n").isNull(), F.col("digest")).otherwise(own))
        .join(bounded_broadcast(cold, hits), "_key", "left")
        .unionByName(probed.where("NOT _may"), allowMissingColumns=True)
    )
    keep_id = F.coalesce("_hot_id", "keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("_hot_n", "group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def by_bytes(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The same rows with the texts themselves as keys, for the day a digest stands for different texts."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select("doc_id", body(F.col("text")).alias("_text"))
    groups = rows.groupBy("_text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "_text").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("_text", 256).alias("text_sha256")
    )
