"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes start at words and are cut after `window` words, the depth that matters. They are divided into groups that
fit in memory by a prefix each: the 16-gram with the least hash in the suffix's window, its anchor, which equal suffixes share
wherever it lies. Neighbouring suffixes under one anchor travel as one segment of words. In each group a subtree is built over
the words themselves: a suffix array by doubling, with the depth that neighbours have in common. Internal nodes of full depth with leaves
in several documents are the repeats; joined in a text, where they overlap, they are its maximal repeats, and all
but those of the first document are removed. Prefixes too frequent for a group are taken at full length instead: each whole
suffix is a node, whose first document is found by aggregation.

Not all suffixes are made. First only anchors (about one for 18 words) are counted, and suffixes
are made only where the anchor occurs in two documents or more. This loses no repeat. Words are compared by 64-bit hashes.

Defined cases: null text has no words; texts of fewer than `window` words keep all; rows with the same
doc_id are one document and do not repeat each other; a null doc_id counts as later than all; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import bounded_broadcast, forget, lookup, sliced, stored
from beamquarry.llm.ngram_join import mixed, word_codes

LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ANCHOR = 16
#: A node that holds more than one in HOT_NODES leaves is among the busiest; so there are fewer than HOT_NODES of them.
HOT_NODES = 1000


class Powers:
    """Powers of BASE and of its inverse, modulo 2^64, as long as the longest text so far."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        while len(cls.up) < n:
            more = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, more, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, more, 1 << 64))])


class Rolling:
    """Hashes of all runs of a text's words, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        Powers.grow(self.n + 1)
        self.codes = word_codes(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes * Powers.up[: self.n])])

    def of(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * Powers.down[starts] + np.uint64(length))

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run of `window` words: where its anchor begins; and the hashes of all 16-grams."""
        grams = self.of(np.arange(self.n - ANCHOR + 1), ANCHOR)
        runs = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1)
        return np.arange(len(runs)) + runs.argmin(axis=1), grams


def anchor_table(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, sign, anchors array<bigint>, places array<int>). `sign` tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, signs, hashes, places = [], [], [], []
            for i, sign, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "sign", "text")), strict=True):
                words = (text or "").encode().split()
                if len(words) >= window:
                    at, grams = Rolling(words).anchors(window)
                    at = np.unique(at)
                    ids.append(i)
                    signs.append(sign)
                    places.append(at.astype(np.int32))
                    hashes.append(grams[at].view(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in places])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(signs, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *hashes]), pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *places]), pa.int32())),
                ],
                ["doc_id", "sign", "anchors", "places"],
            )

    return docs.mapInArrow(run, "doc_id long, sign long, anchors array<long>, places array<int>")


def spans(rolling: Rolling, window: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, low, high) of the runs of window starts, high not included, that share one of the anchors at `places`."""
    at, grams = rolling.anchors(window)
    change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low, high = change, np.concatenate([change[1:], [len(at)]])
    inside = np.isin(at[low], places)
    return grams[at[low[inside]]].view(np.int64), low[inside], high[inside]


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(prefix, doc, sign, start, words): neighbouring suffixes under one anchor, with the hashes of all their words to full depth.

    The anchor is the prefix that the group is chosen by: equal windows have equal anchors, so they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i, sign, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "sign", "text", "places")), strict=True):
                words = (text or "").encode().split()
                if len(words) < window or not places:
                    continue
                rolling = Rolling(words)
                prefix, low, high = spans(rolling, window, np.array(places))
                codes = rolling.codes.tobytes()
                cut = [codes[8 * a : 8 * (b + window - 1)] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                columns = [pa.array(prefix), *[pa.array(np.full(len(low), x, np.int64)) for x in (i, sign)], pa.array(low.astype(np.int32)), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["prefix", "doc", "sign", "start", "words"])

    return docs.mapInArrow(run, "prefix long, doc long, sign long, start int, words binary")


def whole_suffixes(docs: DataFrame, window: int) -> DataFrame:
    """(node, n, low, high): of the suffixes under anchors at `places`, the hash at full depth; a task's batch counts its own leaves and their
    least and greatest document first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, docs_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                found = suffixes_at(text, window, places)[1]
                nodes.append(found)
                docs_.append(np.full(len(found), i, np.int64))
            node, place, n = np.unique(np.concatenate(nodes), return_inverse=True, return_counts=True)
            doc, low, high = np.concatenate(docs_), np.full(len(node), LAST), np.full(len(node), -LAST)
            np.minimum.at(low, place, doc)
            np.maximum.at(high, place, doc)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, n, low, high)], ["node", "n", "low", "high"])

    return docs.mapInArrow(run, "node long, n long, low long, high long")


def suffixes_at(text: str | None, window: int, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes at full depth) of a text's suffixes under the anchors at `places`."""
    words = (text or "").encode().split()
    if len(words) < window or not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rolling = Rolling(words)
    at = np.flatnonzero(np.isin(rolling.anchors(window)[0], places))
    return at, rolling.of(at, window).view(np.int64)


def hot_leaves(docs: DataFrame, window: int, busiest: dict[int, int]) -> DataFrame:
    """(doc, sign, starts, open_starts, open_nodes): a text's leaves under the busiest nodes that are not in their first document, and
    its leaves under other nodes, which are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = np.array(sorted(busiest), np.int64)
        first = np.array([busiest[x] for x in name.tolist()], np.int64)
        for batch in sliced(batches):
            out = [[], [], []]
            for i, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                at, node = suffixes_at(text, window, places)
                k = np.minimum(np.searchsorted(name, node), max(0, len(name) - 1))
                is_busy = (name[k] == node) if len(name) else np.zeros(len(node), bool)
                late = is_busy & (first[k] < i) if len(name) else is_busy
                for column, x in zip(out, (at[late], at[~is_busy], node[~is_busy]), strict=True):
                    column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int64())
            lists = [pa.array([x.astype(k.to_pandas_dtype()) for x in column], pa.list_(k)) for column, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sign"], *lists], ["doc", "sign", "starts", "open_starts", "open_nodes"])

    return docs.mapInArrow(run, "doc long, sign long, starts array<int>, open_starts array<int>, open_nodes array<long>")


class Subtree:
    """The suffix tree of a group's segments down to `window` words, as a suffix array with common-prefix depths.

    `ranks[k]` numbers the runs of 2^k words in lexicographic order, each from the one before by doubling, and two overlapping runs rank
    a suffix at full depth. An internal node is a run of neighbours in the array; its depth is the least of `depths` in it.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, window: int):
        self.window = window
        self.ranks = [np.unique(codes, return_inverse=True)[1]]
        while 2 << (len(self.ranks) - 1) <= window:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            pair = last.copy().astype(np.int64) * (len(codes) + 1)
            pair[:-step] += last[step:] + 1
            self.ranks.append(np.unique(pair, return_inverse=True)[1])
        top = self.ranks[-1]
        rest = window - (1 << (len(self.ranks) - 1))
        self.order = np.lexsort((top[starts + rest], top[starts]))
        self.suffixes = starts[self.order]
        self.depths = self._depths()

    def _depths(self) -> np.ndarray:
        """Words in common with the suffix before, `window` at most; 0 for the first."""
        one, two = self.suffixes[:-1], self.suffixes[1:]
        depth = np.zeros(len(one), np.int64)
        same = np.ones(len(one), bool)
        for k in reversed(range(len(self.ranks))):
            for _ in range(2 if k == len(self.ranks) - 1 else 1):
                fits = same & (depth + (1 << k) <= self.window)
                at = np.where(fits, depth, 0)
                equal = fits & (self.ranks[k][one + at] == self.ranks[k][two + at])
                depth += np.where(equal, 1 << k, 0)
        return np.concatenate([[0], depth]) if len(self.suffixes) else depth

    def deep_nodes(self) -> np.ndarray:
        """The number of each suffix's node of full depth, in the order of the array."""
        return np.cumsum(self.depths < self.window) - 1


def deep_leaves(doc: np.ndarray, sign: np.ndarray, start: np.ndarray, words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc, sign, start) of a group's leaves under nodes of full depth that are not in the node's first document."""
    size = np.array([len(x) // 8 for x in words], np.int64)
    row = np.repeat(np.arange(len(size)), size - window + 1)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size - window + 1) - (size - window + 1), size - window + 1)
    tree = Subtree(np.frombuffer(b"".join(words), np.uint64), (np.cumsum(size) - size)[row] + inside, window)
    leaf, node = tree.order, tree.deep_nodes()
    first = np.full(node[-1] + 1, LAST)
    np.minimum.at(first, node, doc[row[leaf]])
    late = leaf[doc[row[leaf]] > first[node]]
    return doc[row[late]], sign[row[late]], (start[row[late]] + inside[late]).astype(np.int32)


def repeats(texts: DataFrame, cold: DataFrame, hot: DataFrame, suffixes: int, window: int, memory_rows: int) -> DataFrame:
    """(doc, sign, starts) of all suffixes that an earlier document has too; a text may have several rows.

    `cold` and `hot` are stored (doc_id, sign, places) of anchors that fit a group, and of those that are too frequent. A cold
    anchor's suffixes meet in one group; a hot one's are split at full depth: each node's first document is found by aggregation,
    and is told to the leaves of the busiest nodes (fewer than HOT_NODES) by value, to the others by a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, words = [[], [], []], []
        for batch in batches:
            for column, name in zip(columns, ("doc", "sign", "start"), strict=True):
                column.append(batch[name].to_numpy())
            words += batch["words"].to_pylist()
        if words:
            doc, sign, start = deep_leaves(*[np.concatenate(x) for x in columns], words, window)
            order = np.lexsort((start, sign, doc))
            doc, sign, start = doc[order], sign[order], start[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sign[1:] != sign[:-1])])) if len(doc) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(np.ascontiguousarray(start), pa.int32()))
            found = pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(sign[new]), lists], ["doc", "sign", "starts"])
            for low in range(0, found.num_rows, 10_000):
                yield found.slice(low, 10_000)

    groups = max(1, -(-4 * suffixes // memory_rows))
    inside = segments(texts.join(bounded_broadcast(cold, cold), ["doc_id", "sign"]), window)
    found = inside.repartition(groups, F.xxhash64("prefix")).mapInArrow(run, "doc long, sign long, starts array<int>")
    if not hot.limit(1).count():
        return found
    frequent = texts.join(bounded_broadcast(hot, hot), ["doc_id", "sign"])
    nodes = whole_suffixes(frequent, window).groupBy("node").agg(F.sum("n").alias("_n"), F.min("low").alias("_first"), F.max("high").alias("_last"))
    nodes = stored(nodes, "tree-nodes")
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    repeated = nodes.where("_first < _last").select("node", "_first", "_n")
    is_busy = F.col("_n") > max(1, total // HOT_NODES)
    busiest = {r["node"]: r["_first"] for r in repeated.where(is_busy).collect()}  # fewer than HOT_NODES
    leaves = stored(hot_leaves(frequent, window, busiest), "tree-leaves")
    pair = F.explode(F.arrays_zip(F.col("open_starts").alias("start"), F.col("open_nodes").alias("node"))).alias("x")
    others = leaves.where("size(open_starts) > 0").select("doc", "sign", pair).select("doc", "sign", "x.start", "x.node")
    late = others.join(repeated.where(~is_busy), "node").where("doc > _first").groupBy("doc", "sign").agg(F.collect_list("start").alias("starts"))
    return found.unionByName(leaves.where("size(starts) > 0").select("doc", "sign", "starts")).unionByName(late)


def runs_of(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, sign, low array<int>, high array<int>): the covered runs of words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lows, highs = [], []
            for starts in batch["starts"]:
                at = np.unique(starts.values.to_numpy()).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], np.diff(at) > window]))
                lows.append(at[new])
                highs.append(at[np.concatenate([new[1:] - 1, [len(at) - 1]])] + window)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sign"], pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))], ["doc_id", "sign", "low", "high"])

    gathered = found.groupBy(F.col("doc").alias("doc_id"), "sign").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return gathered.mapInArrow(run, "doc_id long, sign long, low array<int>, high array<int>")


def remove_repeats(docs: DataFrame, window: int = 50, memory_rows: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if window < 2 * ANCHOR:
        raise ValueError(f"a window has at least {2 * ANCHOR} words")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("sign"), "text")
    table = stored(anchor_table(texts, window), "tree-anchors")
    each = table.select("doc_id", "sign", F.explode(F.arrays_zip("anchors", "places")).alias("_x")).select("doc_id", "sign", F.col("_x.anchors").alias("anchor"), F.col("_x.places").alias("place"))
    shared = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high")
    shared = stored(shared.select("anchor", "_n"), "tree-shared")
    total = table.agg(F.sum(F.size("places"))).first()[0] or 0
    # an anchor has about window - ANCHOR + 1 suffixes over two, and at most all of them
    often = max(1, memory_rows // (window - ANCHOR + 1))
    held = lookup(each, shared, "anchor", "_n", total).groupBy("doc_id", "sign").agg(
        F.collect_set(F.when(F.col("_n") <= often, F.col("place"))).alias("cold"), F.collect_set(F.when(F.col("_n") > often, F.col("place"))).alias("hot")
    )
    held = stored(held, "tree-places")
    cold, hot = (held.where(F.size(c) > 0).select("doc_id", "sign", F.col(c).alias("places")) for c in ("cold", "hot"))
    cold.scratch_path = hot.scratch_path = held.scratch_path
    suffixes = (held.agg(F.sum(F.size("cold"))).first()[0] or 0) * (window - ANCHOR + 1) // 2
    covered = stored(runs_of(repeats(texts, cold, hot, suffixes, window, memory_rows), window), "tree-runs")
    forget(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, removed, kept = [], [], []
            for text, low, high in zip(batch["text"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                left, at = [], 0
                for a, b in zip(low or [], high or [], strict=True):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = texts.join(bounded_broadcast(covered, covered), ["doc_id", "sign"], "left")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
