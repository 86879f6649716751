"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts stay together. A group that would fill more than 1 / `fine` of a shard in any
of the three sizes is an item of its own (there can be no more than 3 x shards x fine of them), and
one that would fill more than 1 / `split` of a shard is cut into parts by doc_id, so that even a
group of a third of all rows leaves the shards even. All other groups share a fixed number of items, to which they
go by hash; while groups are no more than that, most have an item of their own. So the items are bounded whatever the
input, and are placed on the driver, largest first, each where the dot product of its sizes with the shard's residual
capacity is highest. The many small items that come last even the shards out.

Rows are numbered within a shard in two steps (blocks of rows by hash, then places in a block), so no
shard's rows meet in one task.

Defined cases: null text has no bytes and no tokens, and its rows form a group apart from empty
text; repeated rows are rows of a group; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.llm.common import stored, word_count

SIZES = ("rows", "bytes", "tokens")


def pack_items(sizes: np.ndarray, shards: int, weights: tuple[float, ...] = (1.0, 8.0, 1.0)) -> np.ndarray:
    """The shard of each item (rows of `sizes`): largest first, to the highest dot product of its sizes with what is left.

    Residuals are weighed by size, bytes most, as their law must hold. Of the shards with room in every size; where
    none has room, the one with most left. Equal products go to the smaller shard.
    """
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-300)
    need, w = sizes / capacity, np.array(weights)
    left = np.ones((shards, need.shape[1]))
    out = np.zeros(len(need), np.int64)
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        room = (left >= need[i]).all(axis=1)
        score = np.where(room, left @ (w * need[i]), -np.inf) if room.any() else (left - need[i]) @ w
        out[i] = int(score.argmax())
        left[out[i]] -= need[i]
    return out


def assign(docs: DataFrame, shards: int = 16, split: int = 2, fine: int = 64, bundles: int = 32768) -> DataFrame:
    """One row per document: doc_id, size (bytes + 1), text_crc32, tokens, group, shard, slot."""
    octets = F.col("text").cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(octets), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(octets, F.lit(b""))).alias("text_crc32"),
            word_count(F.col("text")).alias("tokens"),
            F.coalesce(F.unhex(F.sha2(octets, 256)), F.lit(b"null")).alias("group"),
        ),
        "shard-rows",
    )
    sums = (F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    whole = [float(x or 0) for x in rows.agg(*sums).first()]
    share = F.greatest(*[F.col(c) / max(1.0, total / shards) for c, total in zip(SIZES, whole, strict=True)])
    groups = stored(rows.groupBy("group").agg(*sums).withColumn("share", share), "shard-groups")
    large = [(r["group"], max(1, int(np.ceil(r["share"] * split)))) for r in groups.where(F.col("share") > 1 / fine).select("group", "share").collect()]
    spark = docs.sparkSession
    apart = spark.createDataFrame(large or [(b"", 1)], "group binary, parts int").where(F.lit(bool(large)))
    # a large group's item is its number after the bundles and its part; a document's part follows from its doc_id
    numbered = apart.withColumn("first", F.lit(bundles) + F.coalesce(F.sum("parts").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    item = F.when(F.col("first").isNull(), F.pmod(F.xxhash64("group"), F.lit(bundles))).otherwise(
        F.col("first") + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))
    )
    placed = rows.join(F.broadcast(numbered), "group", "left").withColumn("item", item.cast("int")).drop("first", "parts")
    found = placed.groupBy("item").agg(*sums).orderBy("item").collect()
    sizes = np.array([[r[c] for c in SIZES] for r in found], np.float64).reshape(-1, 3)
    to = pack_items(sizes, shards)
    table = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(found, to, strict=True)] or [(0, 0)], "item int, shard int")
    return with_slots(placed.join(F.broadcast(table), "item"), whole[0], shards)


def with_slots(rows: DataFrame, count: float, shards: int, block_rows: int = 16384) -> DataFrame:
    """Number each shard's rows from 0 without gaps."""
    blocks = max(1, int(np.ceil(count / shards / block_rows)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1).join(bases, ["shard", "_block"])
    return numbered.withColumn("slot", (F.col("_base") + F.col("_at")).cast("long")).drop("_block", "_base", "_at")
