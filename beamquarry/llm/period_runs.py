r"""Periodic run detection: all maximal repetitions of a text's words, by Main and Lorentz's divide and conquer.

A run is a stretch of words with a smallest period q, at least two periods and MIN_WORDS long, that no neighbouring word
extends. Words are interned as numbers in their document. A block is cut in the middle; Z-functions of the halves and of
their mirror images tell, for each period, how far a repetition that crosses the cut reaches to both sides; each is extended
over the text, equal intervals are one, and the smallest period stays. Both halves are then searched.

A run holds a stretch of at least MIN_WORDS / 2 words that occurs again one period later, and all of its words lie in such stretches. So only
the parts of a text that are covered by repeated stretches are searched, which leaves out no run. Documents are
independent: there is no shuffle, and a lost task is repeated alone.

Words are runs of characters other than space and \t \n \v \f \r.

Defined cases: null or blank text has no words, no runs and an empty collapsed text; repeated rows are searched alike; rows with equal doc_id stay
apart; an empty table gives an empty result; very long texts are searched whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import sliced
from beamquarry.llm.quality import words

#: Words that a run has at least.
MIN_WORDS = 12
#: Blocks up to this many words are not cut; first words that Z-functions compare for all places at once.
LEAF, HEAD = 96, 4
#: Odd multipliers for the hash of a stretch, which only chooses where to search.
FACTORS = np.random.default_rng(11).integers(1, 1 << 62, MIN_WORDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Line:
    """Interned words with the comparison of stretches, forward and backward."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.mirror = ids, ids[::-1].copy()
        self.raw, self.back = self.ids.tobytes(), self.mirror.tobytes()
        self.width = ids.itemsize

    def ahead(self, i: int, j: int) -> int:
        """How many words from i and from j on are the same."""
        return common(self.ids, self.raw, i, j, len(self.ids) - max(i, j), self.width)

    def behind(self, i: int, j: int) -> int:
        """How many words before i and before j are the same."""
        n = len(self.ids)
        return common(self.mirror, self.back, n - i, n - j, min(i, j), self.width)


def common(x: np.ndarray, raw: bytes, i: int, j: int, limit: int, width: int) -> int:
    done, size = 0, 8
    while done < limit:
        size = min(size, limit - done)
        a, b = i + done, j + done
        if raw[a * width : (a + size) * width] != raw[b * width : (b + size) * width]:
            return done + int((x[a : a + size] != x[b : b + size]).argmax())
        done, size = done + size, 2 * size
    return limit


def z_values(x: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on are the first words again; 0 at the first."""
    n = len(x)
    z, same = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(min(n, HEAD)):
        same = same[: n - k] & (x[k:] == x[k])
        z[: n - k] += same
    raw, width, low, high = x.tobytes(), x.itemsize, 0, 0
    for i in (np.flatnonzero(same[1:]) + 1).tolist() if n > HEAD else ():
        known = HEAD
        if i < high:
            known = int(z[i - low])
            if known < high - i:
                z[i] = known
                continue
            known = high - i
        if i + known < n:
            known += common(x, raw, known, i + known, n - i - known, width)
        z[i], low, high = known, i, i + known
    if n:
        z[0] = 0
    return z


def crossing(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(period, one, before, after): the places, counted from the cut between u and v, that make a repetition with the place one period later.

    The pair is the cut and the place one period before it, or one after. The words before and after a pair that are the same are told by the Z-functions; a repetition
    has at least as many of them as its period.
    """
    gap, found = np.array([-1], u.dtype), []
    for near, far in ((v, u), (u[::-1], v[::-1])):
        p = np.arange(1, len(far) + 1)
        toward = z_values(np.concatenate([near, gap, far]))[len(near) + 1 :][::-1]
        away = np.append(z_values(far[::-1])[1:], 0)
        held = np.flatnonzero(toward + away >= p)
        found.append((p[held], toward[held], away[held]))
    (p, after, before), (q, left, right) = found
    periods = np.concatenate([p, q])
    order = np.argsort(periods, kind="stable")
    return tuple(c[order] for c in (periods, np.concatenate([-p, 0 * q]), np.concatenate([before, left]), np.concatenate([after, right])))


def within(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a short block, by comparing all its places with each other."""
    n = len(x)
    grid = np.zeros((n // 2, n + 2), bool)
    for p in range(1, n // 2 + 1):
        grid[p - 1, 1 : n - p + 1] = x[: n - p] == x[p:]
    turns = np.flatnonzero(grid.ravel()[1:] != grid.ravel()[:-1])
    row, start = np.divmod(turns[::2], n + 2)
    size = turns[1::2] - turns[::2]
    held = size >= np.maximum(least - row - 1, row + 1)
    return row[held] + 1, start[held], np.zeros(held.sum(), np.int64), size[held]


def repetitions(ids: np.ndarray, least: int = MIN_WORDS) -> dict[tuple[int, int], int]:
    """Smallest period of each maximal repetition (start, end) of one stretch of words."""
    line, found, blocks, last = Line(ids), {}, [(0, len(ids))], {}
    while blocks:
        low, high = blocks.pop()
        if high - low < least:
            continue
        if high - low <= LEAF:
            cut, pairs = low, within(ids[low:high], least)
        else:
            cut = (low + high) // 2
            pairs = crossing(ids[low:cut], ids[cut:high])
            blocks += [(cut, high), (low, cut)]
        periods, one, before, after = pairs
        first, end = cut + one - before, cut + one + periods + after
        while len(periods):
            p, a, b, at = int(periods[0]), int(first[0]), int(end[0]), cut + int(one[0])
            s, e = last.get(p, (0, -1))
            if not (s <= a and b <= e):
                s, e = at - line.behind(at, at + p), at + p + line.ahead(at, at + p)
                last[p] = (s, e)
                if e - s >= max(least, 2 * p):
                    found[s, e] = min(p, found.get((s, e), p))
            # of the others, what lies in this run with a multiple of its period is this run
            new = (periods % p != 0) | (first < s) | (end > e)
            periods, one, first, end = periods[new], one[new], first[new], end[new]
    return found


def stretches(ids: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Parts of a text, each covered by stretches of least / 2 words that occur more than once; every run lies in one."""
    size = least // 2
    if len(ids) < least:
        return []
    hashes = np.zeros(len(ids) - size + 1, np.uint64)
    wide = ids.astype(np.uint64)
    for k in range(size):
        hashes += wide[k : len(ids) - size + 1 + k] * FACTORS[k]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(np.isin(hashes, twice))
    edges[at] += 1
    np.subtract.at(edges, at + size, 1)
    inside = np.concatenate([[False], edges.cumsum()[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in turns if b - a >= least]


def runs_of(tokens: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start and period."""
    names = {w: i for i, w in enumerate(tokens)}
    ids = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
    found = [(a + s, e - s, q) for a, b in stretches(ids) for (s, e), q in repetitions(ids[a:b]).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(tokens: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run the first period stays."""
    if not runs:
        return tokens
    edges = np.zeros(len(tokens) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [tokens[i] for i in np.flatnonzero(edges.cumsum()[:-1] == 0).tolist()]


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (the words that stay, one space between)."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, found, ends, left = [], [], [0], []
            for text in batch["text"].cast(pa.binary()):
                tokens = (text.as_py() or b"").split()  # of bytes: at ASCII white space only
                runs = runs_of(tokens)
                counts.append(len(tokens))
                found += runs
                ends.append(len(found))
                left.append(b" ".join(collapsed(tokens, runs)))
            values = pa.StructArray.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], fields=list(run))
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """op11's rows: one document in ten, by its doc_id's CRC-32, goes on periodically from some word to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("_w"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.nullif(F.size("_w"), F.lit(0))).withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    cycle = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    planted = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(cycle, times))), F.lit(1), F.col("_n"))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    return F.reduce(runs, F.element_at(F.slice(runs, 1, 1), 1), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """op11's columns."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.when(F.size("runs") > 0, longest(F.col("runs")))
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("_best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
