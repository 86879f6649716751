"""Joins by nearness: each row with the anchors next to it on an axis, and values between anchors on straight lines.

The axis is cut into buckets at even ranks, so places that crowd in parts of it spread over them all. Rows and anchors of a bucket
are put in order, once upwards and once downwards, and each takes the last anchor before it, so a bucket is read once each way;
where it has none on a side, the nearest bucket that has one gives it. Only distinct places of the rows take part, so a
place that many rows share is no burden, and no window is larger than a bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.session import kept

BUCKETS = 1024


def bucketed(places: DataFrame, buckets: int) -> DataFrame:
    """Places with `_b`, the bucket of `_x`; buckets hold about as many places each. The driver gets their borders."""
    borders = places.where(~F.isnan("_x")).agg(F.percentile_approx("_x", [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    inner = sorted(set(borders) - {float("-inf"), float("inf")})
    if not inner:
        return places.withColumn("_b", F.lit(0))
    split = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")  # NaN is after all
    return split.transform(places).withColumn("_b", F.col("_b").cast("int"))


def neighbours(places: DataFrame, anchors: DataFrame, x: str, buckets: int = BUCKETS) -> DataFrame:
    """(x, below, above): for each distinct place the last anchor at or before it and the first one after it, as structs of the anchors' columns.

    One is null beyond the outermost anchors. Of anchors at one place, the smallest in the order of their columns counts.
    """
    whole = F.struct(x, *[c for c in anchors.columns if c != x])
    known = anchors.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.min(whole).alias("_a"))
    asked = places.select(F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    placed = bucketed(kept(asked.withColumn("_a", F.lit(None).cast(known.schema["_a"].dataType)).unionByName(known), "places"), buckets)
    # at one place the anchor comes first, so it counts as at or before the place; a frame that begins at the bucket's start is read once
    up = Window.partitionBy("_b").orderBy("_x", F.col("_a").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_b").orderBy(F.desc("_x"), F.col("_a").isNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.select("_b", "_x", F.col("_a").isNull().alias("_row"), F.last("_a", True).over(up).alias("_below"), F.last("_a", True).over(down).alias("_above"))
    # a row for each bucket: what the buckets before and after it have
    held = placed.groupBy("_b").agg(F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("_x"))).alias("_last"), F.min_by("_a", F.when(F.col("_a").isNotNull(), F.col("_x"))).alias("_first"))
    all_buckets = Window.orderBy("_b")
    held = held.select(
        "_b", F.last("_last", True).over(all_buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("_first", True).over(all_buckets.rowsBetween(1, Window.unboundedFollowing)).alias("_right")
    )
    found = near.where("_row").join(F.broadcast(held), "_b")  # as many as there are buckets
    return found.select(F.col("_x").alias(x), F.coalesce("_below", "_left").alias("below"), F.coalesce("_above", "_right").alias("above"))


def with_neighbours(rows: DataFrame, anchors: DataFrame, x: str, buckets: int = BUCKETS) -> DataFrame:
    """All rows with `below` and `above`; both are null where x is."""
    near = neighbours(rows, anchors, x, buckets).withColumnRenamed(x, "_x")
    return rows.join(near, rows[x].cast("double") == near["_x"], "left").drop("_x")


def interpolated(rows: DataFrame, anchors: DataFrame, x: str, values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """All rows with the anchors' `values` at their place, on straight lines between anchors; the outermost lines go on beyond the ends.

    A single anchor gives its value everywhere; without any, values are null.
    """
    one = anchors.where(F.col(x).isNotNull()).groupBy(x).agg(F.min(F.struct(*values)).alias("_v")).select(F.struct(F.col(x).cast("double").alias(x), *[F.col(f"_v.{v}").alias(v) for v in values]).alias("_a"))
    few = kept(one, "anchors")
    edges = few.orderBy("_a").limit(2).agg(F.sort_array(F.collect_list("_a")).alias("_low")).join(few.orderBy(F.desc("_a")).limit(2).agg(F.sort_array(F.collect_list("_a")).alias("_high")))
    near = with_neighbours(rows, few.select("_a.*"), x, buckets).join(F.broadcast(edges))  # one row
    inner = F.col("below").isNotNull() & F.col("above").isNotNull()
    pair = F.when(inner, F.array("below", "above")).when(F.col("below").isNull() & F.col("above").isNotNull(), F.col("_low")).when(F.col("below").isNotNull(), F.col("_high"))
    near = near.withColumn("_p", pair).drop("below", "above", "_low", "_high")
    a, b = F.get("_p", F.lit(0)), F.coalesce(F.get("_p", F.lit(1)), F.get("_p", F.lit(0)))

    def at(v: str) -> Column:
        run = b[x] - a[x]
        return a[v] + F.when(run > 0, (F.col(x) - a[x]) * ((b[v] - a[v]) / run)).otherwise(0.0)

    return near.select(*[F.col(c) for c in rows.columns], *[at(v).alias(v) for v in values])
