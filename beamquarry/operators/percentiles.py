"""Exact percentiles of groups of any size and shape.

The built-in aggregates hold a group's distinct values in one buffer. Beyond `buffered` values, ranks are selected instead. For
each wanted rank a bracket of values is narrowed: a sketch of what lies in it gives splitters at even ranks, and exact counts
below, at, between and above the two around the wanted rank tell whether one of them is the answer or what is left between. Ranks, not
distances, place the splitters, so outliers, infinities and repeated values do no harm; each round takes the splitters out and
leaves about a hundredth. Once a bracket holds few values, these are put in order.

Sketches and counts combine before the shuffle; no task receives a group's values, only a bracket's few.
NaN counts as greater than all, as Spark orders it. All columns and ranks go through the same passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.session import kept

#: Values up to which the built-in aggregates are used, and values that a bracket may hold when it is put in order.
BUFFERED, FEW = 5_000_000, 100_000
#: Splitters of a round; the sketch errs by a ten-thousandth of the ranks at most.
SPLITTERS, ACCURACY = 256, 10_000
#: Brackets that are broadcast; more are joined with a shuffle.
BROADCAST_BRACKETS = 50_000


def percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float, str]], buffered: int = BUFFERED, bins: int = SPLITTERS, few: int = FEW) -> DataFrame:
    """(keys, names): `wanted` maps a name to (column, share, kind); kind is "linear" or "nearest" (the smallest value at or above the share).

    Nulls are not counted; a group without values has a null. `rows` is read more than once: store what is dear.
    """
    if rows.count() <= buffered:
        aggs = [F.percentile(c, p).alias(n) if kind == "linear" else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)").alias(n) for n, (c, p, kind) in wanted.items()]
        return rows.groupBy(*keys).agg(*aggs)
    columns = list(dict.fromkeys(c for c, _, _ in wanted.values()))
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    values = rows.select(group.alias("_g"), each.alias("_v")).select("_g", F.col("_v.c").alias("_c"), F.col("_v.x").alias("_x")).where("_x IS NOT NULL")
    sizes = values.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.isnan("_x")).alias("_nan"))
    found = _selected(values.where(~F.isnan("_x")), kept(sizes.join(F.broadcast(_asked(rows, wanted, columns)), "_c"), "ranks"), bins, few)
    sides = [F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_found"))).alias(f"_{i}_{side}") for i, name in enumerate(wanted) for side in (0, 1)]
    counts = [F.max(F.when(F.col("_name") == name, F.col("_n"))).alias(f"_{i}_n") for i, name in enumerate(wanted)]
    wide = found.groupBy("_g").agg(*sides, *counts)
    out = wide.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *[_value(i, name, p, kind) for i, (name, (_, p, kind)) in enumerate(wanted.items())])
    return _joined(rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select(), out, keys)


def _asked(rows: DataFrame, wanted: dict[str, tuple[str, float, str]], columns: list[str]) -> DataFrame:
    """A row for each value that is looked for: a name has one, or two between which it lies."""
    asked = [(columns.index(c), name, p, kind == "linear", side) for name, (c, p, kind) in wanted.items() for side in range(1 + (kind == "linear"))]
    return rows.sparkSession.createDataFrame(asked, "_c int, _name string, _p double, _linear boolean, _side int")


def _value(i: int, name: str, p: float, kind: str) -> Column:
    low, n = F.col(f"_{i}_0"), F.col(f"_{i}_n")
    share = (n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p))
    between = F.when(share == 0, low).otherwise(low * (1 - share) + F.col(f"_{i}_1") * share)
    return (low if kind == "nearest" else between).alias(name)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
    same = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys] or F.lit(True)  # without keys there is one row on each side
    return left.join(right, same, "left").drop(*[f"_r_{k}" for k in keys])


def _with_brackets(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """Values with the brackets that they lie in; ends do not belong to a bracket, and a null end is none."""
    few = brackets.limit(BROADCAST_BRACKETS + 1).count() <= BROADCAST_BRACKETS
    inside = (F.col("_lo").isNull() | (F.col("_x") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi")))
    return values.join(F.broadcast(brackets) if few else brackets, ["_g", "_c"]).where(inside)


#: What tells brackets apart: names that ask for the same rank share one.
ONE = ["_g", "_c", "_rank"]


def _selected(values: DataFrame, asked: DataFrame, bins: int, few: int) -> DataFrame:
    """(_g, _c, _name, _side, _n, _found): the value of each wanted rank."""
    linear = F.least(F.col("_n") - 1, F.floor((F.col("_n") - 1) * F.col("_p")) + F.col("_side"))
    rank = F.when(F.col("_linear"), linear).otherwise(F.greatest(F.lit(0), F.ceil(F.col("_n") * F.col("_p")) - 1)).cast("long")
    todo = asked.withColumn("_rank", rank).withColumn("_in", F.col("_n") - F.col("_nan"))
    none = F.lit(None).cast("double")
    first = todo.where(F.col("_rank") < F.col("_in")).select(*ONE, none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_below"), "_in", none.alias("_one"))
    brackets, done = kept(first.dropDuplicates(ONE), "brackets"), []
    settled = F.col("_one").isNotNull() | (F.col("_in") <= few)
    while brackets.where(~settled).limit(1).count():
        done.append(brackets.where(settled))
        brackets = kept(_narrowed(values, brackets.where(~settled), bins), "brackets")
    for part in done:
        brackets = brackets.unionByName(part)
    counts = _with_brackets(values, brackets.where("_one IS NULL")).groupBy(*ONE, "_below", "_x").agg(F.count(F.lit(1)).alias("_k"))
    up_to = Window.partitionBy(*ONE).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)  # `few` values at most
    placed = counts.withColumn("_end", F.col("_below") + F.sum("_k").over(up_to))
    ordered = placed.where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_k"))).select(*ONE, F.col("_x").alias("_found"))
    found = todo.join(brackets.where("_one IS NOT NULL").select(*ONE, F.col("_one").alias("_found")).unionByName(ordered), ONE, "left")
    return found.withColumn("_found", F.when(F.col("_rank") >= F.col("_in"), float("nan")).otherwise(F.col("_found")))


def _narrowed(values: DataFrame, brackets: DataFrame, bins: int) -> DataFrame:
    """The brackets after one round. Counts are exact, so a splitter on the wrong side of its rank costs a round and no more."""
    sketched = _with_brackets(values, brackets).groupBy(*ONE).agg(F.percentile_approx("_x", [k / bins for k in range(bins + 1)], ACCURACY).alias("_s"))
    place = (F.col("_rank") - F.col("_below")) / F.col("_in") * bins
    low, high = F.greatest(F.lit(0), F.floor(place - 0.1)).cast("int"), F.least(F.lit(bins), F.ceil(place + 0.1)).cast("int")
    split = brackets.join(sketched, ONE).withColumn("_a", F.get("_s", low)).withColumn("_b", F.get("_s", high)).drop("_s")
    split = kept(split, "splitters")
    x, a, b = F.col("_x"), F.col("_a"), F.col("_b")
    kinds = {"under": x < a, "a": x == a, "mid": (x > a) & (x < b), "b": (x == b) & (b > a)}
    seen = _with_brackets(values, split).groupBy(*ONE).agg(*[F.count_if(v).alias(f"_{k}") for k, v in kinds.items()])
    ends, end = [], F.col("_below")
    for name in ("_under", "_at", "_mid", "_bt"):
        end = end + F.col(name)
        ends.append(end)
    rank, lo, hi = F.col("_rank"), F.col("_lo"), F.col("_hi")

    def pick(under, at, mid, bt, above):
        return F.when(rank < ends[0], under).when(rank < ends[1], at).when(rank < ends[2], mid).when(rank < ends[3], bt).otherwise(above)

    none, below = F.lit(None).cast("double"), F.col("_below")
    joined = split.join(seen.withColumnRenamed("_a", "_at").withColumnRenamed("_b", "_bt"), ONE)
    return joined.select(
        *ONE, pick(lo, none, a, none, b).alias("_lo"), pick(a, none, b, none, hi).alias("_hi"), pick(below, below, ends[1], below, ends[3]).alias("_below"),
        pick(F.col("_under"), F.col("_at"), F.col("_mid"), F.col("_bt"), F.col("_in") - (ends[3] - below)).alias("_in"), pick(none, a, none, b, none).alias("_one"),
    )
