"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct shingles of k words (64-bit hashes). Equal sets are one
class from the start. For a threshold t:

* Small sets (up to the boundary) enumerate their subsets of each fixed size that a partner can
  share (t n to n elements). Two small sets that reach t share one of them whole.
* Large sets are found by scanning inverted lists of elements. A set of n enters the lists of its first
  (1 - t) n + c elements in the order of their hashes; partners share c of these lists or more. So, once the
  lists' lengths are known, each set leaves its c - 1 longest lists, and partners still share one. c grows with
  n, so most sets that merely share passages with others leave the lists of these. Small sets that can
  have a large partner are in the lists too.
* Lists that stay heavy (more than HEAVY members) are not met as they are. Partners that share one are both among its members,
  so the members' whole sets are read, and each set is listed again under its rarest elements only, by counts in
  these sets (a table of fixed size, where elements that share a counter count together; any order that all sets share will do): a set of n needs (1 - t) n + 1 of them, and of two partners the smaller one has a common element among its first
  (1 - t) / (1 + t) n + 1, where it is marked `leads`. A passage that many sets share is not among the rarest
  elements of any set that has enough of its own, so crowds that link with nothing leave their lists or lead none.
* The boundary is the size up to which enumerating subsets costs less than the lists, by the lists' measured lengths.

A list is not expanded into all its pairs. First every set is compared with the most connected member of all its
lists, which ties a group of copies together in linear work; then, where components still differ, with the most connected
member of each list. Only members that are in different components even then are compared with each other, long lists in
blocks. A parity sketch (its Hamming distance never exceeds the symmetric difference) drops hopeless pairs inside
the join, and what is left is checked on the full sets, so links are exact up to 64-bit hash collisions.

Defined cases: null or blank text has an empty set and links with nothing; fewer than k words are
one shingle; rows are compared one by one, so texts that share a doc_id are apart unless they link; a null doc_id is never the
smallest, so rows linked to nothing but null doc_ids have a null component; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import bounded_broadcast, forget, lookup, sliced, stored

#: Sets up to this size keep all elements beside their row, so that their subsets can be made.
SMALL = 12
SKETCH_LONGS = 8
#: Members of a list that are met with as many others in one go.
BLOCK = 2048
#: Lists with more members than that are replaced by lists of their members' rarest elements.
HEAVY = 128
#: Counters by which elements of such members are ranked, 8 MB.
COUNTER_BITS = 20
SIGNED = "doc_id long, n int, node long, sketch array<long>, prefix array<long>, small array<long>"


def least(n: int, percent: int) -> int:
    """Elements that a partner of a set of n must share, and so its own least size."""
    return -(-percent * n // 100)


def shared_lists(n: int, percent: int) -> int:
    """c: the lists that a set of n and a partner of its size have in common at least. It never falls as n grows."""
    return 1 + (100 - percent) * n // 200


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least(n, percent) + shared_lists(n, percent))


def dropped(n: int, percent: int) -> int:
    """The longest lists that a set of n may leave: one fewer than it shares with its smallest partner."""
    return shared_lists(least(n, percent), percent) - 1


def equal_share(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with a partner that is no smaller."""
    return -(-2 * percent * n // (100 + percent))


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in range(least(n, percent), n + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. A table of hashes met before would be slower: most of its entries lie out of cache."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased (A-Z) text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_codes(words)
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def node_of(elements: np.ndarray) -> int:
    """The set's own number, equal for equal sets."""
    return int(xxhash.xxh64_intdigest(elements.tobytes())) - (1 << 63)


def subset_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the subsets that a partner can share, of a small set."""
    spread, n = mixed(elements + np.uint64(1)), len(elements)
    whole, parts = int(spread.sum()), spread.tolist()
    found = []
    for c in range(max(1, least(n, percent)), n + 1):
        sums = [whole - sum(gone) for gone in combinations(parts, n - c)]
        found.append(mixed(np.array([s & (2**64 - 1) for s in sums], np.uint64) + np.uint64(c << 48)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def sketch_of(elements: np.ndarray) -> np.ndarray:
    bits = np.bincount((elements & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in arrays)]), pa.int64()))


def signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One narrow row per document: set size, number of the set, sketch, first elements, and all elements if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t, k) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([sketch_of(s) for s in sets], pa.list_(pa.int64())),
                    lists_of([s[: prefix_length(len(s), percent)] for s in sets]),
                    lists_of([s if len(s) <= SMALL else s[:0] for s in sets]),
                ],
                ["doc_id", "n", "node", "sketch", "prefix", "small"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def boundary_of(nodes: DataFrame, lists: DataFrame, percent: int) -> int:
    """The size up to which subsets are cheaper than lists, by what the lists of small sets hold.

    At most SMALL rows come to the driver.
    """
    few = nodes.where(F.col("n") <= SMALL)
    sets = {r["n"]: r["count"] for r in few.groupBy("n").count().collect()}
    read = few.select("node", "n").join(lists, "node").groupBy("n").agg(F.sum("many").alias("read")).collect()
    read = {r["n"]: r["read"] for r in read}
    best, at, gain = 0, 0, 0
    for n in range(1, SMALL + 1):
        gain += sets.get(n, 0) * (prefix_length(n, percent) - subset_count(n, percent)) + read.get(n, 0)
        if gain >= best:
            best, at = gain, n
    return at


def members(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, node, many, leads): the lists that the sets `nodes` stay in, how long the lists were, and whether the set may be the smaller of a pair there.

    Stored. Of elements and of subsets, with heavy lists replaced.
    """
    entries = nodes.select(F.explode("prefix").alias("key"), "node")
    lengths = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "join-lengths")
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    lists = stored(lookup(entries, lengths, "key", "many", total).select("key", "node", "many"), "join-lists")
    boundary = boundary_of(nodes, lists, percent)

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = [subset_keys(x.values.to_numpy().view(np.uint64), percent) for x in batch["small"]]
            yield pa.RecordBatch.from_arrays([batch["node"], lists_of(keys)], ["node", "keys"])

    subsets = nodes.where(F.col("n") <= boundary).select("node", "small").mapInArrow(enumerated, "node long, keys array<long>")
    subsets = subsets.select(F.explode("keys").alias("key"), "node")
    shared = subsets.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    smallest = F.floor((percent * F.col("n") + 99) / 100)
    leaves = F.floor((100 - percent) * smallest / 200).cast("int")  # dropped(n)
    sizes = nodes.where(F.col("n") >= least(boundary + 1, percent)).select("node", leaves.alias("leaves"))
    by_length = F.sort_array(F.collect_list(F.struct("many", "key")))
    of_node = lists.join(sizes, "node").groupBy("node").agg(by_length.alias("all"), F.first("leaves").alias("leaves"))
    kept = of_node.select("node", F.explode(F.slice("all", F.lit(1), F.greatest(F.lit(0), F.size("all") - F.col("leaves")))).alias("x"))
    found = stored(kept.select("x.key", "node", "x.many").unionByName(subsets.join(shared, "key").select("key", "node", "many")), "join-found")
    heavy = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("_stay")).where(F.col("_stay") > HEAVY).select("key"), "join-heavy")
    at_heavy = bounded_broadcast(heavy, heavy)
    light = found.join(at_heavy, "key", "left_anti").withColumn("leads", F.lit(True))
    hot = stored(found.join(at_heavy, "key", "left_semi").select("node").distinct(), "join-hot")
    rare, held = rarest(docs, nodes, hot, k, percent, COUNTER_BITS)
    out = stored(light.unionByName(rare), "join-members")
    forget(lengths, lists, found, heavy, hot, held)
    return out


def counter(elements: np.ndarray, bits: int) -> np.ndarray:
    return (elements >> np.uint64(64 - bits)).astype(np.int64)


def tallied(held: DataFrame, bits: int) -> np.ndarray:
    """How many elements of the sets fall on each counter. Tasks add up what they have first; the driver gets a row a counter at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in sliced(batches):
            at, many = np.unique(counter(np.frombuffer(b"".join(batch["elements"].to_pylist()), np.uint64), bits), return_counts=True)
            total[at] += many
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "many"])

    sums = held.mapInArrow(tally, "at long, many long").groupBy("at").agg(F.sum("many").alias("many")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[sums["at"].to_numpy()] = sums["many"].to_numpy()
    return table


def rarest(docs: DataFrame, nodes: DataFrame, hot: DataFrame, k: int, percent: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, many, leads) of the nodes `hot` under their rarest elements, by counters over these sets; and the stored table it reads.

    An element is in no more sets than its counter says, so those with a counter of 1 are one set's alone. They come first in its
    order and need no list.
    """
    held = full_sets(docs, nodes, hot, k)
    counters = docs.sparkSession.sparkContext.broadcast(tallied(held, bits))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for x in batch["elements"].to_pylist():
                elements = np.frombuffer(x, np.uint64)
                many, n = counters.value[counter(elements, bits)], len(elements)
                order = np.lexsort((elements, many))[int((many == 1).sum()) : n - least(n, percent) + 1]
                leading = n - equal_share(n, percent) + 1 - int((many == 1).sum())
                rows.append((elements[order].view(np.int64), many[order], np.arange(len(order)) < leading))
            if rows:
                key, many, leads = (pa.array(np.concatenate(column)) for column in zip(*rows, strict=True))
                node = np.repeat(batch["node"].to_numpy(), [len(r[0]) for r in rows])
                yield pa.RecordBatch.from_arrays([key, pa.array(node), many, leads], ["key", "node", "many", "leads"])

    return held.mapInArrow(ranked, "key long, node long, many long, leads boolean"), held


def full_sets(docs: DataFrame, nodes: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(node, elements) of the nodes in `named`, read again from their texts. Stored."""
    wanted = stored(nodes.select("node", "doc_id").join(named, "node"), "join-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t, k) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    ids = bounded_broadcast(wanted.select("doc_id").distinct(), wanted)
    rows = texts.join(ids, F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi").select("text").mapInArrow(sets, "node long, elements binary")
    held = stored(rows.join(bounded_broadcast(wanted.select("node"), wanted), "node", "left_semi").dropDuplicates(["node"]), "join-sets")
    forget(wanted)
    return held


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) of nodes that reach the threshold on their full sets."""
    held = full_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = held.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    second = held.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    out = stored(pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "join-links")
    forget(held)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the smallest node reachable, by neighbours' labels and jumps to the label's label. Stored."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    labels = stored(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "join-labels")
    while True:
        at = bounded_broadcast(labels.select(F.col("doc").alias("b"), "component"), labels)
        near = both.join(at, "b").groupBy("a").agg(F.min("component").alias("_near"))
        hop = labels.join(near, labels["doc"] == near["a"]).select("doc", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        top = bounded_broadcast(labels.select(F.col("doc").alias("_at"), F.col("component").alias("_top")), labels)
        new = stored(hop.join(top, hop["component"] == top["_at"], "left").select("doc", "_old", F.least("component", "_top").alias("component")), "join-labels")
        forget(labels)
        labels = new.select("doc", "component")
        labels.scratch_path = new.scratch_path
        if not new.where(F.col("_old") != F.col("component")).limit(1).count():
            forget(both)
            return labels


def may_link(percent: int) -> Column:
    """On rows with (n, sketch) and (n2, sketch2): sizes and sketches allow the threshold."""
    ratio = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    return ratio & (apart * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n2")))


def apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components. Stored."""
    for end in ("a", "b"):
        at = part.select(F.col("doc").alias(end), F.col("component").alias(f"_{end}"))
        pairs = pairs.join(bounded_broadcast(at, part), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return stored(pairs.where("_a <> _b").select("a", "b"), "join-pairs")


def open_pairs(member: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(a, b) of every list's members in different components that may link. Stored.

    Only members outside of a list's largest component are met with the others, as a group of copies is one component by
    now, and one of the two must lead the list. Lists beyond BLOCK are met block by block, so that no task holds more than a
    block of either side.
    """
    at = part.select(F.col("doc").alias("node"), "component")
    placed = member.join(bounded_broadcast(at, part), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"), F.max("leads").alias("_led"))
    lists = sizes.groupBy("key").agg(F.max(F.struct("_n", "component")).alias("_m"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds"), F.max("_led").alias("_led"))
    lists = lists.where("_kinds > 1 AND _led")
    blocks = [F.ceil(x / BLOCK).cast("int").alias(name) for x, name in ((F.col("_all") - F.col("_m._n"), "_p"), (F.col("_all"), "_q"))]
    lists = stored(lists.select("key", "_all", F.col("_m.component").alias("_main"), *blocks), "join-open")
    held = lookup(placed, lists, "key", "_all", member.count()).select("key", "node", "n", "sketch", "leads", "component", "_p", "_q", (F.col("component") == F.col("_main")).alias("_inside"))

    def dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        here = F.pmod(F.xxhash64("node"), F.col(own_count)).cast("int")
        return rows.withColumn(own, here).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))

    # leading members meet all (meeting 0), the others meet leading ones (meeting 1)
    one = dealt(held.where("NOT _inside"), "_i", "_p", "_j", "_q").withColumn("_meeting", F.when(F.col("leads"), 0).otherwise(1))
    one = one.select("key", "_i", "_j", "_meeting", F.col("node").alias("a"), "n", "sketch", "leads", "component")
    meetings = F.when(F.col("leads"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    other = dealt(held, "_j", "_q", "_i", "_p").withColumn("_meeting", F.explode(meetings))
    other = other.select("key", "_i", "_j", "_meeting", F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "sketch", "leads", "component")], "_inside")
    smaller_leads = F.when(F.col("n") < F.col("n2"), F.col("leads")).when(F.col("n") > F.col("n2"), F.col("leads2")).otherwise(F.col("leads") & F.col("leads2"))
    differ = (F.col("_inside") | (F.col("a") < F.col("b"))) & (F.col("component") != F.col("component2"))
    met = one.join(other, ["key", "_i", "_j", "_meeting"]).where(differ & smaller_leads & may_link(percent))
    out = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-pairs")
    forget(lists)
    return out


def linked(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, component) of all nodes that have a link; stored."""
    lists = members(docs, nodes, k, percent)
    links = lists.groupBy("node").agg(F.sum("many").alias("links"))
    traits = stored(nodes.select("node", "n", "sketch").join(links, "node"), "join-traits")
    member = lists.select("key", "node", "leads").join(bounded_broadcast(traits, traits), "node")
    hubs = member.groupBy("key").agg(F.max(F.struct("links", "node", "n", "sketch")).alias("_m"), F.count(F.lit(1)).alias("_members"))
    hubs = hubs.where("_members > 1").select("key", "_members", F.col("_m.node").alias("a"), F.col("_m.links").alias("links2"), F.col("_m.n").alias("n2"), F.col("_m.sketch").alias("sketch2"))
    hubs = stored(hubs, "join-hubs")
    stars = lookup(member, hubs, "key", "_members", lists.count()).where((F.col("node") != F.col("a")) & may_link(percent)).select("a", F.col("node").alias("b"), "links2").distinct()
    stars = stored(stars, "join-stars")
    first = stored(stars.groupBy("b").agg(F.max(F.struct("links2", "a")).alias("_m")).select(F.col("_m.a").alias("a"), "b"), "join-first")
    edges = [verified(docs, nodes, first, k, percent)]
    part = components(edges[0])
    for more in (lambda: apart(stars, part), lambda: open_pairs(member, part, percent)):
        pairs = more()
        edges.append(verified(docs, nodes, pairs, k, percent))
        old, part = part, components(edges[0].unionByName(edges[1]) if len(edges) == 2 else edges[0].unionByName(edges[1]).unionByName(edges[2]))
        forget(pairs, old)
    forget(lists, traits, hubs, stars, first, *edges)
    return part


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    signs = stored(signed(docs, k, percent).withColumn("row", F.monotonically_increasing_id()), "join-signs")
    classes = stored(signs.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("_copies"), F.min("row").alias("_first")).where("_copies > 1"), "join-classes")
    named = signs.join(bounded_broadcast(classes.select("node", "_first"), classes), "node", "left")
    nodes = named.where("n > 0 AND (_first IS NULL OR _first = row)")
    part = linked(docs, nodes, k, percent)
    at = part.select(F.col("doc").alias("node"), "component")
    rows = named.select("doc_id", "n", "node", F.col("_first").isNotNull().alias("_copied")).join(bounded_broadcast(at, part), "node", "left")
    rows = rows.withColumn("_group", F.when(F.col("component").isNotNull() | F.col("_copied"), F.coalesce("component", "node")))
    lowest = stored(rows.where("_group IS NOT NULL").groupBy("_group").agg(F.min("doc_id").alias("_low")), "join-lowest")
    return rows.join(bounded_broadcast(lowest, lowest), "_group", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("_low", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that have their component's smallest doc_id, in the columns of docs.

    Of rows that share a doc_id one stays, that of the smallest text; each row with a null doc_id stays.
    """
    gone = stored(join(docs, k, percent).where("component_id < doc_id").select("doc_id"), "join-gone")
    kept = docs.join(bounded_broadcast(gone, gone), "doc_id", "left_anti").select(*docs.columns)
    many = stored(kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("doc_id"), "join-repeated")
    row = F.struct(*docs.columns)
    one = kept.join(bounded_broadcast(many, many), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("_row"))
    return kept.join(bounded_broadcast(many, many), "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("_row.*"))
