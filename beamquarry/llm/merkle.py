"""Merkle dataset manifest: a hash tree for each group of rows, a tree over the groups' roots, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves of a group ascend by identifier and every
FANOUT consecutive nodes become one, until one is left: the group's root. The groups' roots, in the order of the
groups, become the root of the dataset in the same way. A level is one window over (group, parent index): the ordered
list of its full frame is the parent's preimage and holds each child's siblings; of the rows that a
parent then has, one goes on to the next level.

Places are numbers over a whole group, however large: rows are dealt by range of (group, identifier) and numbered in their
part, and the counts of the parts before are added. So no group ever meets in one task; windows hold FANOUT rows.

Defined cases: a null field counts as `-`; a null group is a group of its own and comes first; a null identifier comes first in its
group; rows that share group and identifier are ordered by their leaves, and repeated rows are leaves of their own; a
group of one row has its leaf as its root; an empty table gives an empty result; columns other than the five
fields are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.llm.common import bounded_broadcast, lookup, stored

#: Fixed value: nodes that become one.
FANOUT = 16
#: Fixed value: the fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(**other: Column) -> Column:
    """A row's leaf; `other` takes the place of fields, for a row that was changed."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Stored rows with `_at`, a row's place in its `_group`, and `_n`, the group's size. The last key of the order is a row's own number, so that equal rows spread too."""
    keyed = rows.withColumn("_own", F.monotonically_increasing_id())
    keys = ["_group", *order, "_own"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_row", F.monotonically_increasing_id())
    placed = stored(dealt.withColumn("_part", F.shiftright("_row", 33)), "merkle-places")
    counts = placed.groupBy("_group", "_part").agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_here"))
    # a row for each part that a group lies in
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).withColumn("_n", F.sum("_here").over(Window.partitionBy("_group")))
    parts = stored(parts, "merkle-parts")
    joined = placed.join(bounded_broadcast(parts, parts), ["_group", "_part"])
    return joined.withColumn("_at", F.col("_row") - F.col("_low") + F.col("_before")).drop("_row", "_part", "_low", "_here", "_before")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs (_group, _parent, _n, _run) of each level, lowest first, and the roots (_group, digest), of nodes (_group, _at, _n, digest)."""
    levels, roots = [], []
    height = nodes.agg(F.max("_n")).first()[0] or 1
    while height > 1:
        roots.append(nodes.where("_n = 1"))
        frame = Window.partitionBy("_group", "_parent").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = nodes.where("_n > 1").withColumn("_parent", F.floor(F.col("_at") / FANOUT)).withColumn("_run", F.collect_list("digest").over(frame))
        first = seen.where(F.col("_at") % FANOUT == 0)
        levels.append(stored(first.select("_group", "_parent", "_n", "_run"), "merkle-level"))
        above = F.ceil(F.col("_n") / FANOUT).alias("_n")
        nodes = levels[-1].select("_group", F.col("_parent").alias("_at"), above, digest(F.array_join("_run", "")).alias("digest"))
        height = -(-height // FANOUT)
    return levels, reduce(DataFrame.unionByName, [x.select("_group", "digest") for x in [*roots, nodes.where("_n = 1")]])


def step(run: Column, i: Column) -> Column:
    """What stands left and right of child i of a run."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), i), "").alias("left"), F.array_join(F.slice(run, i + 2, F.lit(FANOUT)), "").alias("right"))


def paths(levels: list[DataFrame]) -> DataFrame:
    """(_group, _parent, _run, _path): the lowest level's runs with the steps from their parents to the root of the group."""
    none = F.array().cast(STEP)
    above = None
    for runs in reversed(levels):
        if above is None:
            here = runs.withColumn("_path", none)
        else:  # groups that ended at this level have nothing above
            here = runs.join(above, ["_group", "_parent"], "left").withColumn("_path", F.coalesce("_path", none))
        children = here.select("_group", "_parent", "_run", "_path", F.posexplode("_run").alias("_i", "_"))
        at = F.col("_parent") * FANOUT + F.col("_i")
        above = children.select("_group", at.alias("_parent"), F.concat(F.array(step(F.col("_run"), F.col("_i"))), "_path").alias("_path"))
    return here.select("_group", "_parent", "_run", "_path")


def steps(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (_group, _at) with `_steps`, from a row's own siblings up to the root of its group."""
    none = F.array().cast(STEP)
    if not levels:
        return rows.withColumn("_steps", none)
    found = rows.withColumn("_parent", F.floor(F.col("_at") / FANOUT)).join(paths(levels), ["_group", "_parent"], "left")
    own = F.array(step(F.col("_run"), (F.col("_at") % FANOUT).cast("int")))
    return found.withColumn("_steps", F.when(F.col("_run").isNull(), none).otherwise(F.concat(own, "_path"))).drop("_run", "_path", "_parent")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["left"], node, x["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def manifest(docs: DataFrame, group: str = "source", **carried: Column) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path (array of left and right), and the columns `carried`, computed from docs."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(group)), F.lit("-"))  # in the order of the groups, null first
    own = {f"_{k}": v for k, v in carried.items()}
    leaves = docs.select("doc_id", key.alias("_group"), leaf().alias("digest"), *[v.alias(k) for k, v in own.items()])
    leaves = stored(numbered(stored(leaves, "merkle-leaves"), "doc_id", "digest"), "merkle-numbered")
    levels, subroots = tree(leaves.select("_group", "_at", "_n", "digest"))
    sizes = leaves.where("_at = 0").select("_group", F.col("_n").alias("_size"))
    tops = numbered(stored(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "digest"), "merkle-subroots"), "_name")
    top_levels, root = tree(tops.select("_group", "_at", "_n", "digest"))
    known = root.first()  # one row; none for an empty table
    above = steps(tops, top_levels).select(F.col("_name").alias("_group"), F.col("digest").alias("subroot"), F.col("_steps").alias("_top"))
    above = stored(above.join(sizes, "_group"), "merkle-tops")
    rows = lookup(leaves.drop("_n"), above, "_group", "_size", leaves.count())
    path = F.concat("_steps", "_top")
    whole = steps(rows, levels).withColumn("root", F.lit(known["digest"] if known else None).cast("string"))
    return whole.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", path.alias("path"), *[F.col(k).alias(k[1:]) for k in own])


def audit(docs: DataFrame, presented: Column) -> DataFrame:
    """The manifest of docs and, for the leaf that is presented for each row, the root it folds to and whether that is the dataset's."""
    rows = manifest(docs, presented=presented)
    return rows.withColumn("folded_root", fold(F.col("presented"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The leaf of op12's rows: of one row in five the text's A to Z are lower-cased."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf(text=F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).otherwise(leaf())
