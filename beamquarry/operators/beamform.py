"""Beamforming in two physical forms of one plan.

Relational form: one row per sample, an equi-join with the weights and a grouped sum; it is checked
against SQL. Packed samples are dealt to tasks once, by spectrum or by window (`dealt`, `by_window`); sums over antennas are columns,
one for each beam, and become rows where they are made, so neither beams nor power are shuffled. Frame form: one row per (t, f) with a packed payload, multiplied with the weights of its
channel in NumPy inside Arrow batches, with power and the window sum taken before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import BEAM_TILE, MAX_BEAMS

#: Weights of a full cube: 128 beams x 336 channels x 256 antennas; the bound under which they travel to all tasks.
MAX_WEIGHTS = MAX_BEAMS * 336 * 256
#: Rows of a weight table up to which a join broadcasts it: some 40 MB.
BROADCAST_WEIGHTS = 1_000_000
#: Beams whose sums share a row; more take several rows.
LANES = 16
#: Samples times beams that a task puts together: some 100 MB of sums.
TASK_VALUES = 4_000_000
#: The sample of each byte.
SAMPLES = np.array([((b & 15) ^ 8) - 8 + 1j * (((b >> 4) ^ 8) - 8) for b in range(256)], np.complex64)


def steering_weights(beams: DataFrame, channels: DataFrame, antennas: DataFrame) -> DataFrame:
    """(b, f, a, wr, wi): exp(+i phase), phase in double. The three tables are fixed by the dimensions, so the product is too."""
    angle = S.phase(*(F.col(c) for c in ("hz", "x", "y", "z", "l", "m", "n")))
    grid = beams.crossJoin(F.broadcast(channels)).crossJoin(F.broadcast(antennas)).withColumn("_phase", angle)
    return grid.select("b", "f", "a", F.cos("_phase").alias("wr"), F.sin("_phase").alias("wi"))


def tiled(weights: DataFrame) -> DataFrame:
    """(f, tile, a, lane, wr, wi): the layout with beams in tiles; lanes past the last beam are zero."""
    whole = weights.groupBy("f", "a").agg(F.max("b").alias("_last"))
    lanes = whole.select("f", "a", F.explode(F.sequence(F.lit(0), (F.floor(F.col("_last") / BEAM_TILE) + 1) * BEAM_TILE - 1)).alias("b"))
    full = lanes.join(weights, ["f", "a", "b"], "left").na.fill(0.0, ["wr", "wi"])
    return full.select("f", F.floor(F.col("b") / BEAM_TILE).alias("tile"), "a", (F.col("b") % BEAM_TILE).alias("lane"), "wr", "wi")


def decode(voltage: DataFrame) -> DataFrame:
    """(t, f, a, re, im) from (t, f, a, byte)."""
    return voltage.select("t", "f", "a", S.unpack_re(F.col("byte")).alias("re"), S.unpack_im(F.col("byte")).alias("im"))


def dealt(rows: DataFrame, by: tuple[str, ...], values: int) -> DataFrame:
    """Rows shuffled by the columns `by`; grouping by these and others then stays in the tasks.

    Each row comes to `values` sums or so, and the number of tasks grows with the rows, so that what one holds does not.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() * values // TASK_VALUES)), *by)


def by_window(rows: DataFrame, spectra: int, values: int) -> DataFrame:
    """Rows with their window `w`, dealt by it."""
    return dealt(rows.withColumn("w", F.floor(F.col("t") / spectra).cast("long")), ("w",), values)


def side_by_side(weights: DataFrame, lanes: int, on: tuple[str, ...]) -> DataFrame:
    """(on, _tile, wr0, wi0, wr1, ..., _held): the weights of `lanes` beams in a row; the bits of `_held` tell which of them there are."""
    lane = F.col("b") % lanes
    each = [F.sum(F.when(lane == k, F.col(c))).alias(f"{c}{k}") for k in range(lanes) for c in ("wr", "wi")]
    return weights.groupBy(*on, F.floor(F.col("b") / lanes).alias("_tile")).agg(*each, F.bit_or(reduce(lambda x, k: x.when(lane == k, 1 << k), range(1, lanes), F.when(lane == 0, 1))).alias("_held"))


def complex_sums(samples: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("t", "f"), on: tuple[str, ...] = ("f", "a")) -> DataFrame:
    """(keys, b, sr, si): sum of w x over antennas (no conjugate) by keys and beam. Weights are broadcast if they are counted to be few; a full cube is shuffled."""
    few = weights.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS
    lanes = min(LANES, 1 + (weights.agg(F.max("b")).first()[0] or 0))
    wide = side_by_side(weights, lanes, on)
    joined, re, im = samples.join(F.broadcast(wide) if few else wide, list(on)), F.col("re"), F.col("im")
    sums = []
    for k in range(lanes):
        wr, wi = F.col(f"wr{k}"), F.col(f"wi{k}")
        sums += [F.sum(wr * re - wi * im).alias(f"sr{k}"), F.sum(wr * im + wi * re).alias(f"si{k}")]
    summed = joined.groupBy(*keys, "_tile").agg(*sums, F.bit_or("_held").alias("_held"))
    beams = F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(1 << k).alias("bit"), F.col(f"sr{k}").alias("sr"), F.col(f"si{k}").alias("si")) for k in range(lanes)])
    rows = summed.select(*keys, "_tile", "_held", F.explode(beams).alias("x")).where(F.col("_held").bitwiseAND(F.col("x.bit")) != 0)
    return rows.select(*keys, (F.col("_tile") * lanes + F.col("x.lane")).cast(weights.schema["b"].dataType).alias("b"), "x.sr", "x.si")


def beamform(samples: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("t", "f")) -> DataFrame:
    """(keys, b, power) of decoded samples."""
    sums = complex_sums(samples, weights, keys)
    return sums.select(*keys, "b", S.power(F.col("sr"), F.col("si")).alias("power"))


def beamform_packed(voltage: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, f, b, power) of packed samples, dealt by spectrum."""
    return beamform(decode(dealt(voltage, ("t",), LANES)), weights)


def beamform_windows(voltage: DataFrame, weights: DataFrame, spectra: int) -> DataFrame:
    """(w, t, f, b, power) of packed samples, dealt by window: sums over windows, and over tiles of one, are made where the power is."""
    placed = by_window(voltage, spectra, LANES)
    return beamform(placed.select("w", "t", "f", "a", S.unpack_re(F.col("byte")).alias("re"), S.unpack_im(F.col("byte")).alias("im")), weights, ("w", "t", "f"))


def apply_loss_mask(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """Keep only what the mask calls valid; by default nothing is masked anywhere."""
    return frames.join(mask.where("valid").select("t", "f"), ["t", "f"], "left_semi")


def integrate(power: DataFrame, spectra: int, keys: tuple[str, ...] = ("f", "b"), value: str = "power") -> DataFrame:
    """Sum over windows of `spectra` samples; a partial last window is kept, and `spectra_summed` says how full each is.

    A place has one row at most, so spectra are counted by rows, in the same shuffle as the sum. Windows `w` that the rows were
    dealt by (`beamform_windows`) are taken as they are.
    """
    if spectra <= 0:
        raise ValueError("integration count must be positive")
    window = "w" if "w" in power.columns else F.floor(F.col("t") / spectra).cast("long").alias("w")
    return power.groupBy(window, *keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("spectra_summed"))


# --- frame form


def unpack_frames(payload: np.ndarray) -> np.ndarray:
    """complex64 samples of packed bytes."""
    return np.take(SAMPLES, payload)


def weight_cube(weights: DataFrame, n_beams: int, n_freq: int, n_ant: int) -> np.ndarray:
    """[f][a][b] complex64 on the driver, for the tasks' closures; refused beyond a full cube."""
    if n_beams * n_freq * n_ant > MAX_WEIGHTS:
        raise ValueError("weights exceed a full cube")
    cube = np.zeros((n_freq, n_ant, n_beams), np.complex64)
    table = weights.select("f", "a", "b", "wr", "wi").toArrow()
    f, a, b, wr, wi = (table[c].to_numpy() for c in ("f", "a", "b", "wr", "wi"))
    cube[f, a, b] = wr + 1j * wi
    return cube


def to_frames(voltage: DataFrame, n_ant: int) -> DataFrame:
    """(t, f, payload) of (t, f, a, byte) with one sample at most for a place; missing ones are zero."""
    place = F.struct("a", "byte")
    packed = voltage.groupBy("t", "f").agg(F.collect_list(place).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_s"]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            a, byte = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            cube = np.zeros((batch.num_rows, n_ant), np.uint8)
            cube[row, a] = byte
            payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_ant), batch.num_rows, [None, pa.py_buffer(cube)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["t"], batch["f"], payload], ["t", "f", "payload"])

    return packed.mapInArrow(run, "t long, f int, payload binary")


def frame_power(frames: DataFrame, cube: np.ndarray) -> DataFrame:
    """(t, f, power array<float>): one matrix product for each channel of a batch."""
    shared = frames.sparkSession.sparkContext.broadcast(cube)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch["f"].to_numpy()
            x = unpack_frames(payload_matrix(batch["payload"], shared.value.shape[1]))
            power = _powers(x, f, shared.value)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(power.ravel()), power.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch["t"], batch["f"], flat], ["t", "f", "power"])

    return frames.select("t", "f", "payload").mapInArrow(run, "t long, f int, power array<float>")


def payload_matrix(payload: pa.Array, n_ant: int) -> np.ndarray:
    """Rows of a binary column as a byte matrix without copying each row; each must have n_ant bytes."""
    offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1]
    if not (np.diff(offsets) == n_ant).all():
        raise ValueError(f"payloads must have {n_ant} bytes")
    return np.frombuffer(payload.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(payload), n_ant)


def _powers(x: np.ndarray, f: np.ndarray, cube: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), cube.shape[2]), np.float32)
    for k in np.unique(f):
        rows = np.flatnonzero(f == k)
        y = x[rows] @ cube[k]
        out[rows] = y.real * y.real + y.imag * y.imag
    return out


def frame_integrated(frames: DataFrame, cube: np.ndarray, spectra: int) -> DataFrame:
    """(w, f, b, power): window sums of power. Each task sums what it has of a window first, so that the
    shuffle carries one row for a window, channel and task instead of one for a spectrum."""
    shared = frames.sparkSession.sparkContext.broadcast(cube)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f, w = batch["f"].to_numpy(), batch["t"].to_numpy() // spectra
            power = _powers(unpack_frames(payload_matrix(batch["payload"], shared.value.shape[1])), f, shared.value)
            key, inverse = np.unique(np.stack([w, f]), axis=1, return_inverse=True)
            sums = np.zeros((key.shape[1], power.shape[1]))
            np.add.at(sums, inverse.ravel(), power)
            beams = power.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key[0], beams)), pa.array(np.repeat(key[1].astype(np.int32), beams)), pa.array(np.tile(np.arange(beams, dtype=np.int32), key.shape[1])), pa.array(sums.ravel())],
                ["w", "f", "b", "power"],
            )

    parts = frames.select("t", "f", "payload").mapInArrow(run, "w long, f int, b int, power double")
    return parts.groupBy("w", "f", "b").agg(F.sum("power").alias("power"))
