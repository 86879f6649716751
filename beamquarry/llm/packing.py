"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Each window gives each queue a quantum in proportion to
its weight; a queue serves the whole tokens of its deficit and carries the rest to the next
window. So all windows are full (all but the very last) and every one of them, anywhere in
the output, holds the target proportions to a token or so for each queue.

To run in parallel, windows are grouped in rounds. What the queues have served by the start of
any round follows from the queues' totals alone (service by virtual time, the next token going
to the queue that has waited longest), so a round knows the deficits that it takes over without
running the rounds before it. A round holds `round_windows` windows of tokens, whatever
the sizes of sources and documents, and is one group of one task.

Defined cases: null text is empty and packs as its end token alone; a null source is a queue
of its own; rows count one by one, so repeated rows are packed as often as they occur; an empty
table gives no sequence; other columns are not read. Every source has its own queue, however many there
are; the driver and the tasks hold two numbers for each. More than `max_queues` are numbered by a join.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamquarry.llm.common import bounded_broadcast, stored

TOKENS = "doc_id long, queue string, chunk long, at long, n long, ids binary"
PARTS = "round long, queue int, place long, doc_id long, start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source_queue int, ids binary"


#: Fixed values of the word vocabulary: its pre-tokenizer's pieces, here for lower-case Latin-1 text. The most frequent kind is tried first.
PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\r\f\va-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: What the fast way does not cover: characters outside of this, and strings of special tokens.
UNCOMMON = re.compile(r"[^ \t\n\r\f\v!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\|")


#: Texts on which the two ways are compared, so that a vocabulary of other rules is told.
PROBES = ("Two words, it's  12 o'clock!", "", " a\nb\tc ", "na\u00efve \u00c9t\u00e9 \u00df?!...", "x_y-z 3.14 (we'll) #$%")


#: The ASCII part of what it covers.
PLAIN = bytes([*b" \t\n\r\f\v", *range(33, 127)])


def common(text: str) -> bool:
    """Whether the fast way covers a text; most are ASCII, for which no pattern is needed."""
    if text.isascii():
        return "<|" not in text and not text.encode().translate(None, PLAIN)
    return not UNCOMMON.search(text)


class Byte(dict):
    """The byte-level alphabet: bytes with a visible Latin-1 character stand for it, the others for 256, 257, ..."""

    def __init__(self):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        super().__init__({b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)})


class Pieces(dict):
    """Packed ids of pieces, found by the tokenizer's model when first asked for; emptied when it holds `limit`."""

    def __init__(self, model, code: str, limit: int):
        super().__init__()
        self.model, self.code, self.limit, self.byte = model, code, limit, Byte()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        seen = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
        found = self[piece] = array(self.code, [k.id for k in self.model.tokenize(seen)]).tobytes()
        return found


class PieceIds:
    """Token ids of texts, one cached entry for each piece that the pre-tokenizer makes.

    The word vocabulary drops white space, lowers case and never joins pieces, so a text's ids are its pieces'
    ids in order. Texts of common characters are cut into pieces here; any other text is cut at
    white space only, and its words go through the whole tokenizer. Another vocabulary, as told by a probe of both ways,
    goes through the whole tokenizer text by text.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces = Pieces(self.tokenizer.model, "H" if self.kind == "<u2" else "I", limit)
        self.fast = True
        self.fast = all(self.of([t], 1) == self.whole([t], 1) for t in PROBES)

    def uncommon(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in text.encode().split()], add_special_tokens=False)
        return array(self.pieces.code, [i for e in found for i in e.ids]).tobytes()

    def whole(self, texts: list[str | None], end: int) -> list[bytes]:
        tail = array(self.pieces.code, [end]).tobytes()
        return [array(self.pieces.code, e.ids).tobytes() + tail for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def of(self, texts: list[str | None], end: int) -> list[bytes]:
        if not self.fast:
            return self.whole(texts, end)
        tail, ids = array(self.pieces.code, [end]).tobytes(), self.pieces.__getitem__
        return [(b"".join(map(ids, PIECE.findall(t.lower()))) if common(t) else self.uncommon(t)) + tail for t in (t or "" for t in texts)]


def tokenise(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(doc_id, queue, chunk, at, n, ids): `at` is the document's place among its queue's tokens in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = PieceIds(tokenizer)
        width, chunk = np.dtype(words.kind).itemsize, TaskContext.get().partitionId() << 24
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = words.of(part["text"].to_pylist(), end)
                queue = part["queue"].to_pylist()
                at, n, sums = [], [], {}
                for q, x in zip(queue, ids, strict=True):
                    at.append(sums.get(q, 0))
                    n.append(len(x) // width)
                    sums[q] = at[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(queue, pa.string()), pa.array([chunk] * len(ids), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "chunk", "at", "n", "ids"],
                )
                chunk += 1

    queue = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    return docs.select(F.col("doc_id").cast("long"), queue.alias("queue"), "text").mapInArrow(run, TOKENS)


class Service:
    """What each queue has served when a number of tokens has been packed.

    Queue s has n_s tokens and weight w_s; its token i is due at virtual time (i + p_s) / w_s.
    The phases p_s are spread over 0 to 1, so that many small queues do not all come due at once.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.n = np.array(totals, np.int64)
        self.w = np.array(weights if weights else totals, np.float64)
        self.w = np.maximum(self.w, 1e-9) / max(self.w.sum(), 1e-9)
        self.phase = (np.arange(1, len(self.n) + 1) * 0.6180339887498949) % 1.0

    def level(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Virtual time at which tokens that could be divided would sum to `packed`, and the weight still served then.

        Found in the order in which queues end.
        """
        order = np.argsort(self.n / self.w)
        n, w = self.n[order], self.w[order]
        filled = np.cumsum(n) + n / w * (w.sum() - np.cumsum(w))
        k = np.minimum(np.searchsorted(filled, packed), len(n) - 1)
        rate = np.cumsum(w[::-1])[::-1][k]
        return (packed - np.concatenate([[0], np.cumsum(n)])[k]) / rate, rate

    def ideal(self, packed: np.ndarray) -> np.ndarray:
        """What each queue would have served if tokens could be divided, len(packed) x queues."""
        return np.minimum(self.n, self.w * self.level(packed)[0][:, None])

    def at(self, packed: np.ndarray) -> np.ndarray:
        """Whole tokens served: of all tokens by (due time, queue), the first `packed`. So it never falls as `packed` grows."""
        time, rate = self.level(packed)
        slack = (len(self.n) + 2) / rate
        low = np.clip(np.floor(self.w * (time - slack)[:, None] + 1 - self.phase), 0, self.n).astype(np.int64)
        high = np.clip(np.floor(self.w * (time + slack)[:, None] + 1 - self.phase) + 1, 0, self.n).astype(np.int64)
        for row, top, want in zip(low, high, packed, strict=True):
            q = np.repeat(np.arange(len(row)), top - row)
            i = np.arange(len(q)) - np.repeat(np.cumsum(top - row) - (top - row), top - row) + row[q]
            first = np.lexsort((q, (i + self.phase[q]) / self.w[q]))[: int(want - row.sum())]
            row += np.bincount(q[first], minlength=len(row))
        return low

    def last(self, packed: int) -> tuple[float, int]:
        """(due time, queue) of the last of the first `packed` tokens."""
        served = self.at(np.array([packed], np.int64))[0]
        some = np.flatnonzero(served)
        due = (served[some] - 1 + self.phase[some]) / self.w[some]
        return float(due.max()), int(some[due == due.max()].max())

    def until(self, q: int, border: tuple[float, int]) -> int:
        """Tokens of queue q that are due no later than the border, a (due time, queue)."""
        n, w, phase = int(self.n[q]), float(self.w[q]), float(self.phase[q])
        i = min(n, int(border[0] * w))
        while i < n and ((i + phase) / w, q) <= border:
            i += 1
        while i and ((i - 1 + phase) / w, q) > border:
            i -= 1
        return i


def round_borders(spark: SparkSession, service: Service, round_tokens: int) -> list[tuple[float, int]]:
    """(due time, queue) of each round's last token, found by tasks: each looks at all queues."""
    total = int(service.n.sum())
    rounds = -(-total // round_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [service.last(min(total, (k + 1) * round_tokens)) for k in batch["id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32())], ["id", "due", "queue"])

    parts = max(1, min(rounds, spark.sparkContext.defaultParallelism))
    return [(r["due"], r["queue"]) for r in sorted(spark.range(0, rounds, 1, parts).mapInArrow(run, "id long, due double, queue int").collect())]


def split_rounds(rows: DataFrame, service: Service, round_tokens: int) -> DataFrame:
    """Cut each document's tokens at the rounds' borders."""
    borders = round_borders(rows.sparkSession, service, round_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, q, p, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "queue", "place", "n", "ids")), strict=True):
                width, start, left = len(ids) // n, 0, n
                k = bisect_left(borders, ((p + float(service.phase[q])) / float(service.w[q]), q))
                while left:
                    take = min(left, service.until(q, borders[k]) - p)
                    if take > 0:
                        for column, x in zip(out, (k, q, p, doc, start, n, ids[start * width : (start + take) * width]), strict=True):
                            column.append(x)
                        start, left, p = start + take, left - take, p + take
                    k += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["round", "queue", "place", "doc_id", "start", "doc_tokens", "ids"])

    return rows.mapInArrow(run, PARTS)


def windows_in_turn(left: np.ndarray, weights: np.ndarray, deficit: np.ndarray, window: int, later: np.ndarray | bool = False, idle: float = 0.0) -> Iterator[np.ndarray]:
    """Tokens that each queue serves in each window, until the queues are empty.

    `deficit` is what the queues are owed at the start. Queues that do not end before `later`, and `idle` (the weight of
    those without tokens now), keep their share of the room.
    """
    left, deficit = left.astype(np.int64).copy(), deficit.astype(np.float64).copy()
    while (total := int(left.sum())) > 0:
        room = min(window, total)
        active = left > 0
        deficit += np.where(active, weights, 0) * (room / (weights[active | later].sum() + idle))
        serve = np.clip(np.floor(deficit + 1e-6).astype(np.int64), 0, left)
        while (off := room - int(serve.sum())) != 0:
            can = (serve < left) if off > 0 else (serve > 0)
            order = np.argsort(np.where(can, -(deficit - serve) * np.sign(off), np.inf), kind="stable")[: int(can.sum())]
            if abs(off) < len(order):
                serve[order[: abs(off)]] += np.sign(off)
            else:
                each = abs(off) // len(order)
                serve[order] += np.sign(off) * np.minimum(each, (left - serve)[order] if off > 0 else serve[order])
        deficit -= serve
        left -= serve
        yield serve


def deficit_round_robin(left: np.ndarray, weights: np.ndarray, deficit: np.ndarray, window: int) -> np.ndarray:
    """All windows in turn, windows x queues."""
    rows = list(windows_in_turn(left, weights, deficit, window))
    return np.array(rows).reshape(len(rows), len(left))


def pack_round(part: pd.DataFrame, service: Service, window: int, round_windows: int, kind: str) -> pd.DataFrame:
    """One round: its windows by deficit round-robin, its documents cut at the windows."""
    number = int(part["round"].iloc[0])
    part = part.sort_values(["queue", "place"], kind="stable")
    width = np.dtype(kind).itemsize
    length = part["ids"].str.len().to_numpy() // width
    present, queue = np.unique(part["queue"].to_numpy(), return_inverse=True)  # queues without tokens here have no turn
    have = np.bincount(queue, weights=length).astype(np.int64)
    begun = np.array([number * round_windows * window], np.int64)
    owed = (service.ideal(begun)[0] - service.at(begun)[0])[present]
    going = service.n / service.w >= service.level(np.minimum(begun + round_windows * window, service.n.sum()))[0] * (1 - 1e-9)
    idle = max(0.0, float(service.w[going].sum() - service.w[present][going[present]].sum()))
    # turns with tokens only, of which there are no more than tokens: window, queue, tokens
    turns = [(np.full(np.count_nonzero(x), t), np.flatnonzero(x), x[x > 0]) for t, x in enumerate(windows_in_turn(have, service.w[present], owed, window, going[present], idle))]
    turn, q, count = (np.concatenate(x) for x in zip(*turns, strict=True))
    before = np.cumsum(count) - count - turn * window  # all windows are full but the very last
    order = np.lexsort((turn, q))
    turn, q, before, stops = turn[order], q[order], before[order], np.cumsum(count[order])
    # all tokens of the round lie in one row, queue after queue; cuts are the parts' and the turns' borders in it
    ids = np.frombuffer(b"".join(part["ids"]), kind).astype("<u4")
    ends = np.cumsum(length)
    cuts = np.unique(np.concatenate([[0], ends, stops]))
    low, size = cuts[:-1], np.diff(cuts)
    row, at = np.searchsorted(ends, low, side="right"), np.searchsorted(stops, low, side="right")
    offset = before[at] + low - (stops - count[order])[at]
    raw = ids.tobytes()
    return pd.DataFrame(
        {
            "doc_id": part["doc_id"].to_numpy()[row],
            "start": part["start"].to_numpy()[row] + low - (ends - length)[row],
            "length": size,
            "doc_tokens": part["doc_tokens"].to_numpy()[row],
            "sequence_id": number * round_windows + turn[at],
            "offset": offset,
            "source_queue": present[q[at]].astype(np.int32),
            "ids": [raw[4 * a : 4 * (a + n)] for a, n in zip(low.tolist(), size.tolist(), strict=True)],
        }
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    window: int = 2048,
    weights: dict[str | None, float] | None = None,
    round_windows: int = 256,
    max_queues: int = 1024,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, source_queue, ids (unsigned 32-bit).

    Weights are by source; without them, sources weigh what they hold, so that the mixture is the same
    to the end. A queue that ends leaves its share to the others.
    """
    tokens = stored(tokenise(docs, tokenizer, end), "pack-tokens", compression="zstd")
    spark = docs.sparkSession
    names = sorted(r[0] for r in tokens.select("queue").distinct().collect())
    many = max(1, len(names))
    shares = [float((weights or {}).get(name[1:] if name[0] == "a" else None, 0.0)) for name in names] if weights else None
    if len(names) > max_queues:
        numbers = stored(spark.createDataFrame(pd.DataFrame({"queue": names, "_number": np.arange(many, dtype=np.int32)}), "queue string, _number int"), "pack-queues")
        rows = tokens.join(bounded_broadcast(numbers, numbers), "queue").drop("queue").withColumnRenamed("_number", "queue")
    else:
        at = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))]) if names else None
        rows = tokens.withColumn("queue", at[F.col("queue")] if names else F.lit(0))
    sums = stored(rows.groupBy("queue", "chunk").agg(F.sum("n").alias("n")), "pack-chunks")
    totals = [0] * many
    for q, n in sums.groupBy("queue").agg(F.sum("n")).collect():
        totals[q] = n
    service = Service(totals, shares)
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.join(bounded_broadcast(bases, sums), ["queue", "chunk"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("place"), "n", "ids")
    kind = PieceIds(tokenizer).kind

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pack_round(part, service, window, round_windows, kind)

    return split_rounds(placed, service, window * round_windows).groupBy("round").applyInPandas(run, PIECES)
