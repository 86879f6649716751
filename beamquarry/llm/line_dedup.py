"""Line deduplication by pairwise alignment: blocks of lines that an earlier document has too are deleted from the later one.

Pairs are found through the hashes of rare lines. A line by itself may be short and anywhere, so what is hashed is a line with the
neighbours that it needs for `min_chars` characters (line ends do not count), once with those after it and once with those
before it; a document of n lines has at most 2 n of these. A document is paired with the first holder of each that it shares: one partner
for all copies of a neighbourhood, so a line in very many documents makes one pair for each of them, and none is left unpaired.

The two documents of a pair are aligned by patience diff on what they share: neighbourhoods that are unique in both and rise in
both are ties, gaps between ties are aligned in the same way, and a gap without unique ones by an exact diff. What
is left has been moved or repeated in the later document; it is cut into pieces that rise, each aligned by itself, so nothing is left. Aligned blocks, which have
`min_chars` characters or more, are deleted from the later document. Each pair is judged on the input, so order of work does not
matter, and every block that a document shares with one of smaller doc_id goes, wherever it stands in the two and however many documents
hold it. Neighbourhoods are compared by 64-bit hashes, and text is not moved.

Defined cases: null text stays null and has no lines; a document that repeats a line keeps the repeats
unless the line is shared; rows with the same doc_id are one document and are not compared with each
other; a null doc_id counts as later than all; an empty table gives an empty result; other columns are
passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import WORD, bounded_broadcast, lookup, sliced, stored
from beamquarry.llm.substring_dedup import Rolling

LAST = (1 << 63) - 1


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (i, j), i rising, in which j rises too (patience sorting with back pointers)."""
    tops, ends, back = [], [], []
    for at, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [j]
        ends[pile : pile + 1] = [at]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def exact(a: list, b: list, low_a: int, high_a: int, low_b: int, high_b: int) -> list[tuple[int, int]]:
    """The longest common subsequence of two stretches: the longest rise through all places that agree, later places of b first."""
    places = defaultdict(list)
    for j in range(high_b - 1, low_b - 1, -1):
        places[b[j]].append(j)
    return rising([(i, j) for i in range(low_a, high_a) for j in places.get(a[i], ())])


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of a and b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        ties = rising([(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place])
        if not ties:
            out += exact(a, b, a0, a1, b0, b1)
            continue
        at, bt = a0, b0
        for i, j in ties:
            todo.append((at, i, bt, j))
            out.append((i, j))
            at, bt = i + 1, j + 1
        todo.append((at, a1, bt, b1))
    return sorted(out)


def alignments(a: list, b: list) -> Iterator[list[tuple[int, int]]]:
    """The alignment of b with a, whose entries are all different, and then one for each piece of b that it leaves: in such a piece the places in a rise."""
    ties = patience(a, b)
    yield ties
    tied, place, piece = {j for _, j in ties}, {x: i for i, x in enumerate(a)}, []
    for j in range(len(b)):
        if j not in tied and b[j] in place:
            if piece and place[b[j]] <= piece[-1][0]:
                yield piece
                piece = []
            piece.append((place[b[j]], j))
    if piece:
        yield piece


def common_blocks(a: list, b: list, seed: list[bool]) -> list[int]:
    """Lines of b in blocks aligned with a, of those blocks that hold a seed line of b."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if any(seed[x] for x in block):
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def blocks_of(lengths: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the shortest blocks from each line and up to each line, high not included."""
    n = len(lengths)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.searchsorted(sums, sums[:n] + min_chars)
    starts = np.searchsorted(sums, sums[1:] - min_chars, side="right") - 1
    fits, holds = ends <= n, starts >= 0
    low = np.concatenate([np.flatnonzero(fits), starts[holds]])
    high = np.concatenate([ends[fits], np.flatnonzero(holds) + 1])
    each = np.unique(low * (n + 1) + high)
    return each // (n + 1), each % (n + 1)


def block_table(texts: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, sign, h, low, high): the blocks of all texts. `sign` tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [[np.empty(0, k)] for k in (np.int64, np.int64, np.int64, np.int32, np.int32)]
            for i, sign, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "sign", "text")), strict=True):
                lines = text.split("\n")
                low, high = blocks_of(np.fromiter(map(len, lines), np.int64, len(lines)), max(1, min_chars))
                if len(low):
                    h = Rolling([x.encode() for x in lines]).of(low, high - low).view(np.int64)
                    for column, x in zip(columns, (np.full(len(low), i), np.full(len(low), sign), h, low.astype(np.int32), high.astype(np.int32)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["doc_id", "sign", "h", "low", "high"])

    return texts.where("text IS NOT NULL").mapInArrow(run, "doc_id long, sign long, h long, low int, high int")


def aligned_lines(shared: list[dict]) -> np.ndarray:
    """Which lines of a document go, up to the last that does, of what it shares: (first, place, h, low, high), the partner, the place there, and the lines here."""
    partners = defaultdict(list)
    for x in shared:
        partners[x["first"]].append(x)
    change = np.zeros(max(x["high"] for x in shared) + 1, np.int64)
    for rows in partners.values():
        rows.sort(key=lambda x: (x["low"], x["high"]))
        places = {x["h"]: (x["place"], x["high"] - x["low"]) for x in rows}
        for ties in alignments(sorted(places, key=lambda h: (*places[h], h)), [x["h"] for x in rows]):
            for _, j in ties:
                change[rows[j]["low"]] += 1
                change[rows[j]["high"]] -= 1
    return np.cumsum(change)[:-1] > 0


def deletions(docs: DataFrame, min_chars: int, rare: int) -> DataFrame:
    """(doc_id, sign, gone array<boolean>): for each line up to the last that goes, whether it goes."""
    blocks = stored(block_table(docs.select("doc_id", "sign", "text"), min_chars), "line-blocks")
    start = F.min(F.struct("doc_id", "low"))  # the first holder and its first place
    groups = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("df"), start.alias("_start"), F.max("doc_id").alias("_last")).where(F.col("_start.doc_id") < F.col("_last"))
    groups = stored(groups.select("h", "df", F.col("_start.doc_id").alias("first"), F.col("_start.low").alias("place")), "line-groups")
    later = lookup(blocks, groups, "h", "df", blocks.count(), least=rare).where("first < doc_id")
    found = later.groupBy("doc_id", "sign").agg(F.collect_set(F.struct("first", "place", "h", "low", "high")).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            gone = [aligned_lines(shared.as_py()) for shared in batch["shared"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sign"], pa.array(gone, pa.list_(pa.bool_()))], ["doc_id", "sign", "gone"])

    return found.mapInArrow(run, "doc_id long, sign long, gone array<boolean>")


def aligned(docs: DataFrame, min_chars: int = 20, rare: int = 64) -> DataFrame:
    """All columns of docs with `text` after deletion, and n_lines, n_deleted.

    `rare` steers the join only: blocks in more places than that may be broadcast. The result is the same for any.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    sign = F.xxhash64("text")
    gone = stored(deletions(docs.select(key.alias("doc_id"), sign.alias("sign"), "text"), min_chars, rare), "line-gone")
    named = gone.select(F.col("doc_id").alias("_id"), F.col("sign").alias("_sign"), F.col("gone").alias("_gone"))
    rows = docs.select("text", key.alias("_id"), sign.alias("_sign"), F.struct(*docs.columns).alias("_doc"))
    keep = F.expr("filter(split(text, '\n'), (x, i) -> NOT coalesce(get(_gone, i), false))")
    rows = rows.join(bounded_broadcast(named, gone), ["_id", "_sign"], "left").withColumn("_kept", F.when(F.col("_gone").isNotNull(), keep))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    left = F.when(F.col("_gone").isNull(), lines).otherwise(F.size("_kept"))
    columns = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_deleted")]
    return rows.select(*columns, text.alias("text"), lines.cast("long").alias("n_lines"), (lines - left).cast("long").alias("n_deleted"))


def clean(docs: DataFrame, min_chars: int = 20, rare: int = 64) -> DataFrame:
    """The documents in their columns, without the deleted lines; those left without a word go."""
    inner = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    out = aligned(inner, min_chars, rare).where((F.col("n_deleted") == 0) | F.regexp_like("text", F.lit(WORD)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
