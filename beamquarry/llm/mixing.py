"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The budget of words is cut into equal blocks. Sources get blocks by highest quotients
(weight / (2k + 1)), each source's blocks go to its shards in the same way, and in each
shard the blocks come from the documents in a seeded order. A source that is short of its
target is passed over several times, never more often than `max_repeats`.

Defined cases: null or blank text has size 0 and takes 0; a null source is a source of its
own and sorts last; repeated rows count one by one, under a null or shared doc_id too; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.llm.common import SPACES, stored, word_count

#: Rows of a shard, about: a hot source is cut into as many shards as it needs.
SHARD_ROWS = 8192


def sainte_lague(df: DataFrame, group: Sequence[str], key: str, weight: str, seats: str, quota: str) -> DataFrame:
    """Add `quota`: each row's share of its group's `seats` by highest quotients weight / (2k + 1).

    Only quotients next to the ideal share are ranked, about four for each row, so the cost
    does not depend on the number of seats. Ties go to the smaller key. A group without weight gets 0.
    """
    whole = Window.partitionBy(*group)
    base = (
        df.withColumn("_sum", F.sum(weight).over(whole).cast("double"))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_ideal", F.when(F.col("_sum") > 0, F.col(seats) / F.col("_sum")).otherwise(0.0))
        .withColumn("_delta", F.when(F.col("_sum") > 0, (F.col("_n") / 2 + 1) / F.col("_sum")).otherwise(0.0))
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col(weight) * (F.col("_ideal") - F.col("_delta")) + 0.5)))
        .withColumn("_high", F.floor(F.col(weight) * (F.col("_ideal") + F.col("_delta")) + 0.5) + 1)
        .withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    )
    ranked = Window.partitionBy(*group).orderBy(F.desc("_quotient"), F.asc(key), F.asc("_k"))
    won = (
        base.where((F.col("_sum") > 0) & (F.col(weight) > 0))
        .select(*group, key, weight, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_k"))
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*group, key)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        base.join(won, [*group, key], "left")
        .withColumn(quota, F.when(F.col("_sum") > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long"))
        .drop("_sum", "_n", "_ideal", "_delta", "_low", "_high", "_left", "_won")
    )


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """Add `target` to (_source, source_size): the budget by weight, held at max_repeats times the size.

    Filling up in the order of cap / weight gives in one pass what sharing the excess again
    and again would give.
    """
    order = Window.orderBy("_source")
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        sources.withColumn("_at", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_at") + 1))
        .withColumn("_cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_rank", F.row_number().over(by_cap))
        .withColumn("_rest", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest_w", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.greatest(F.col("_rest_w"), F.lit(1e-300)))
        .withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
        .withColumn("_line", F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("_rank"))).over(every))
        .withColumn("_first", F.min(F.when(F.col("_free"), F.col("_rank"))).over(every))
        .withColumn("target", F.when(F.col("_rank") >= F.col("_first"), F.least(F.col("_line") * F.col("_w"), F.col("_cap"))).otherwise(F.col("_cap")))
        .select("_source", "source_size", "_docs", "target", "_budget")
    )


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))


def row_sign() -> Column:
    """Tells rows of one doc_id apart; rows that agree in it and in doc_id are taken alike."""
    return F.xxhash64(source_key(), F.col("text"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
    block_words: int = 8,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, row_sign, size, source_size, target and taken words (repeats counted)."""
    sized = stored(docs.select("doc_id", row_sign().alias("row_sign"), source_key().alias("_source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    targets = source_targets(sources, weights, share, max_repeats).withColumn("_seats", F.round(F.col("_budget") / block_words).cast("long"))
    plan = stored(sainte_lague(targets, [], "_source", "target", "_seats", "_blocks"), "mix-sources")

    spread = F.greatest(F.lit(1), F.ceil(F.col("_docs") / SHARD_ROWS))
    drawn = F.coalesce(F.col("doc_id").cast("long"), F.col("row_sign"))
    placed = (
        sized.join(plan.select("_source", "_docs"), "_source")
        .withColumn("_draw", F.xxhash64(F.lit(seed), drawn))
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), drawn), spread))
        .select("doc_id", "row_sign", "_source", "size", "_draw", "_shard")
    )
    shards = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_shard_size"))
    quotas = sainte_lague(shards.join(plan, "_source"), ["_source"], "_shard", "_shard_size", "_blocks", "_quota")
    run = Window.partitionBy("_source", "_shard").orderBy("_draw", "doc_id", "row_sign", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("_quota") * block_words
    passes = F.when(F.col("_shard_size") > 0, F.least(F.lit(max_repeats).cast("long"), F.floor(words / F.col("_shard_size")))).otherwise(F.lit(0))
    extra = F.when(F.col("_passes") < max_repeats, words - F.col("_passes") * F.col("_shard_size")).otherwise(F.lit(0))
    return (
        placed.withColumn("_at", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(quotas, ["_source", "_shard"])
        .withColumn("_passes", passes)
        .withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("_at"))))
        .select(
            "doc_id",
            "row_sign",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            F.col("target").cast("double").alias("target"),
            (F.col("_passes") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
        )
    )


def apply_mix(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents as the mix takes them: a row for each whole pass, and the first words of the last part.

    Documents of which nothing is taken go. `taken` is what mix() gives for docs. Rows with the same doc_id,
    source and text lie side by side in the mix, so what each of them gets follows from their number and sum.
    """
    columns = docs.columns
    same = ("_none", "_id", "_sign")
    by_row = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    parts = (
        taken.groupBy(by_row[0].alias("_none"), by_row[1].alias("_id"), F.col("row_sign").alias("_sign"))
        .agg(F.max("size").alias("_size"), F.count(F.lit(1)).alias("_rows"), F.sum("taken").alias("_sum"))
        .where("_sum > 0")
    )
    rows = docs.select(F.struct(*columns).alias("_doc"), by_row[0].alias("_none"), by_row[1].alias("_id"), row_sign().alias("_sign"))
    at = F.row_number().over(Window.partitionBy(*same).orderBy("_sign")) - 1
    whole = F.floor(F.col("_sum") / (F.col("_rows") * F.col("_size")))
    rest = F.col("_sum") - F.col("_whole") * F.col("_rows") * F.col("_size") - F.col("_at") * F.col("_size")
    ends = rf"(?<=[^{SPACES}])(?=[{SPACES}])"
    left = F.col("_taken") - F.col("_pass") * F.col("_size")
    text = F.col("_doc.text")
    cut = F.array_join(F.slice(F.split(text, ends), F.lit(1), left.cast("int")), "")
    new = {"text": F.when(left >= F.col("_size"), text).otherwise(cut)}
    return (
        rows.join(parts, list(same))
        .withColumn("_at", at)
        .withColumn("_whole", whole)
        .withColumn("_taken", F.col("_whole") * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest)))
        .where("_taken > 0")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))))
        .select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in columns])
    )
