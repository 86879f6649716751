"""A single beam that follows a straight path in direction cosines, steered anew for each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import LIGHT_M_S, Dimensions, Trajectory, window_count
from beamquarry.operators import beamform


def window_directions(samples: DataFrame, path: Trajectory, spectra: int, n_time: int | None = None) -> DataFrame:
    """(w, l, m, n) for the windows of the samples; each window looks where the path is at its first sample.

    With n_time given, the whole path is checked before any work.
    """
    if n_time is not None:
        path.check(n_time, spectra)
    w = samples.select(F.floor(F.col("t") / spectra).cast("long").alias("w")).distinct()
    return steer(w, path, spectra)


def all_windows(spark, path: Trajectory, spectra: int, n_time: int) -> DataFrame:
    path.check(n_time, spectra)
    return steer(spark.range(window_count(n_time, spectra)).select(F.col("id").alias("w")), path, spectra)


def steer(windows: DataFrame, path: Trajectory, spectra: int) -> DataFrame:
    t = F.col("w") * spectra
    lm = windows.withColumn("l", path.l0 + t * path.l_rate).withColumn("m", path.m0 + t * path.m_rate)
    return lm.withColumn("n", S.unit_n(F.col("l"), F.col("m")))


def kinematics(spark, path: Trajectory, spectra: int, n_time: int) -> DataFrame:
    """(t, l, m, steered_l, steered_m, error_arcmin): where the source is at each sample, where its window looks, and how far apart they are."""
    path.check(n_time, spectra)
    t = F.col("t")
    begin = F.floor(t / spectra) * spectra
    at = {f"{a}{c}": start + x * rate for a, x in (("", t), ("steered_", begin)) for c, start, rate in (("l", path.l0, path.l_rate), ("m", path.m0, path.m_rate))}
    rows = spark.range(n_time).select(F.col("id").alias("t")).select("t", *[v.alias(k) for k, v in at.items()])
    return rows.withColumn("error_arcmin", S.pointing_error_arcmin(*(F.col(c) for c in ("l", "m", "steered_l", "steered_m"))))


def transit(spark, half_deg: float, points: int, apertures: dict[int, float], wave_m: float, floor: float = 1e-4) -> DataFrame:
    """(n_ant, i, deg, power, db) of a source that crosses a beam: the sinc^2 of each array's aperture, decibels down to a floor."""
    table = F.explode(F.create_map(*[F.lit(x) for pair in apertures.items() for x in pair])).alias("n_ant", "aperture")
    deg = -half_deg + F.col("id") * (2 * half_deg / (points - 1))
    rows = spark.range(0, points, 1, 1).select(F.col("id").alias("i"), deg.alias("deg"), table)
    power = S.sinc2(F.col("aperture") / wave_m * F.sin(F.radians("deg")))
    return rows.withColumn("power", power).withColumn("db", 10 * F.log10(F.greatest("power", F.lit(floor)))).drop("aperture")


def overlap_series(windows: DataFrame, path: Trajectory, spectra: int, stride: int, limit: int) -> DataFrame:
    """Every stride-th window of the path, `limit` of them at most: the frames of a report."""
    return steer(windows.where(F.col("w") % stride == 0).orderBy("w").limit(limit), path, spectra)


def track(samples: DataFrame, directions: DataFrame | Trajectory, channels: DataFrame, antennas: DataFrame, spectra: int) -> DataFrame:
    """(t, f, power) of decoded samples: one output a spectrum.

    The phase is computed for each sample from its window's direction, which costs a sine and a cosine
    where a join with a table of all windows' weights would cost a row for each window, channel and
    antenna. The antenna and channel tables are bounded by the dimensions. A path's directions are arithmetic on the window;
    directions of another kind are a table that grows with time and is joined by window.
    """
    placed = (
        samples.withColumn("w", F.floor(F.col("t") / spectra).cast("long"))
        .join(F.broadcast(channels), "f")
        .join(F.broadcast(antennas), "a")
    )
    placed = steer(placed, directions, spectra) if isinstance(directions, Trajectory) else placed.join(directions, "w")
    angle = S.phase(*(F.col(c) for c in ("hz", "x", "y", "z", "l", "m", "n")))
    wr, wi = F.cos("_phase"), F.sin("_phase")
    summed = placed.withColumn("_phase", angle).groupBy("t", "f").agg(
        F.sum(wr * F.col("re") - wi * F.col("im")).alias("sr"), F.sum(wr * F.col("im") + wi * F.col("re")).alias("si")
    )
    return summed.select("t", "f", S.power(F.col("sr"), F.col("si")).alias("power"))


def track_packed(voltage: DataFrame, *rest) -> DataFrame:
    return track(beamform.decode(voltage), *rest)


def track_frames(frames: DataFrame, path: Trajectory, hz, positions, spectra: int, precise: bool = False) -> DataFrame:
    """(t, f, power) in frame form: hz[f] and positions[a] (x, y, z) as arrays; steering once for each window and channel of a batch.

    Weights and sums are in single precision; `precise` takes double.
    """
    hz, positions = np.asarray(hz, float), np.asarray(positions, float)
    kind = np.complex128 if precise else np.complex64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, f = batch["t"].to_numpy(), batch["f"].to_numpy()
            x = beamform.unpack_frames(beamform.payload_matrix(batch["payload"], len(positions)))
            key, inverse = np.unique(np.stack([t // spectra, f]), axis=1, return_inverse=True)
            look = np.array([path.at(w * spectra) for w in key[0]]).reshape(-1, 3)
            angle = 2 * np.pi / LIGHT_M_S * hz[key[1]][:, None] * (look @ positions.T)
            y = np.einsum("ra,ra->r", x.astype(kind), np.exp(1j * angle).astype(kind)[inverse.ravel()])
            power = y.real * y.real + y.imag * y.imag
            yield pa.RecordBatch.from_arrays([batch["t"], batch["f"], pa.array(power, pa.float64() if precise else pa.float32())], ["t", "f", "power"])

    return frames.select("t", "f", "payload").mapInArrow(run, f"t long, f int, power {'double' if precise else 'float'}")


def channel_weights(hz, positions, look) -> np.ndarray:
    """[f][part][a][2] float32: what a sample's real (part 0) and imaginary part (1) add to the real and imaginary part of the beam."""
    angle = 2 * np.pi / LIGHT_M_S * hz[:, None] * (positions @ np.array(look))
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([np.stack([c, s], axis=-1), np.stack([-s, c], axis=-1)], axis=1).astype(np.float32)


def window_power(payload: np.ndarray, weights: np.ndarray, slice_channels: int = 16) -> np.ndarray:
    """[t][f] of one window's packed bytes [t][f][a]: some channels at a time, small enough to stay in cache, as two real products each."""
    out = np.empty(payload.shape[:2], np.float32)
    for low in range(0, payload.shape[1], slice_channels):
        here = slice(low, low + slice_channels)
        packed = np.ascontiguousarray(payload[:, here].transpose(1, 0, 2)).view(np.int8)
        y = np.matmul((packed << 4 >> 4).astype(np.float32), weights[here, 0]) + np.matmul((packed >> 4).astype(np.float32), weights[here, 1])
        out[:, here] = (y[..., 0] ** 2 + y[..., 1] ** 2).T
    return out


def spectra_power(t: np.ndarray, payload: np.ndarray, path: Trajectory, hz: np.ndarray, positions: np.ndarray, spectra: int, slice_rows: int = 512) -> np.ndarray:
    """[t][f] of whole spectra [t][f][a]; steering is computed once for each window, and at most `slice_rows` spectra are multiplied at a time."""
    power, window = np.empty(payload.shape[:2], np.float32), t // spectra
    for w in np.unique(window):
        weights, here = channel_weights(hz, positions, path.at(w * spectra)), np.flatnonzero(window == w)
        for low in range(0, len(here), slice_rows):
            at = here[low : low + slice_rows]
            if at[-1] - at[0] + 1 == len(at):
                at = slice(at[0], at[-1] + 1)  # no copy
            power[at] = window_power(payload[at], weights)
    return power


def _power_batch(t: np.ndarray, power: np.ndarray) -> pa.RecordBatch:
    flat = pa.FixedSizeListArray.from_arrays(pa.array(power.ravel()), power.shape[1]).cast(pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(t), flat], ["t", "power"])


def track_spectra(rows: DataFrame, path: Trajectory, hz, positions, spectra: int, slice_rows: int = 512) -> DataFrame:
    """(t, power array<float>) of whole spectra (t, payload of all channels' elements in turn): one row for each spectrum."""
    hz, positions = np.asarray(hz, float), np.asarray(positions, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, payload = batch["t"].to_numpy(), beamform.payload_matrix(batch["payload"], len(hz) * len(positions))
            yield _power_batch(t, spectra_power(t, payload.reshape(len(t), len(hz), len(positions)), path, hz, positions, spectra, slice_rows))

    return rows.select("t", "payload").mapInArrow(run, "t long, power array<float>")


def track_tensor(spark, path_name: str, dims: Dimensions, path: Trajectory, hz, positions, spectra: int, windows: int = 1) -> DataFrame:
    """The same for a raw tensor of [t][f][element] bytes: each task reads the byte ranges of its windows itself, so samples go from the file to the product."""
    from beamquarry.sources import rawfile

    hz, positions = np.asarray(hz, float), np.asarray(positions, float)
    layout = rawfile.Layout((("t", "long", dims.n_time),), ("payload",), "bytes", dims.n_freq * dims.n_ant)
    reader = rawfile.TensorReader(path_name, layout, spectra * windows * layout.width)
    parts = reader.partitions()  # a number for each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_pylist():
                first, last = k * spectra * windows, min(dims.n_time, (k + 1) * spectra * windows)
                raw = np.frombuffer(reader.bytes_of(first, last), np.uint8).reshape(last - first, dims.n_freq, dims.n_ant)
                t = np.arange(first, last)
                yield _power_batch(t, spectra_power(t, raw, path, hz, positions, spectra))

    return spark.range(0, len(parts), 1, min(len(parts), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "t long, power array<float>")


def _relational(frames: DataFrame, path: Trajectory, channels: DataFrame, antennas: DataFrame, spectra: int) -> DataFrame:
    from beamquarry.sources.tensors import decoded

    samples = decoded(frames, antennas.count())
    return track(samples, path, channels, antennas, spectra)


def _frame(precise: bool):
    def run(frames: DataFrame, path: Trajectory, channels: DataFrame, antennas: DataFrame, spectra: int) -> DataFrame:
        hz = [r["hz"] for r in channels.orderBy("f").collect()]  # a few hundred channels and antennas
        positions = [(r["x"], r["y"], r["z"]) for r in antennas.orderBy("a").collect()]
        return track_frames(frames, path, hz, positions, spectra, precise)

    return run


ENGINES = {"relational": _relational, "frame": _frame(False), "frame_precise": _frame(True)}


def run_engine(name: str, frames: DataFrame, path: Trajectory, channels: DataFrame, antennas: DataFrame, spectra: int) -> DataFrame:
    """(t, f, power) of packed frames by the named engine: one logical operator, whose physical form the name picks."""
    if name not in ENGINES:
        raise ValueError(f"engine is one of {', '.join(ENGINES)}")
    return ENGINES[name](frames, path, channels, antennas, spectra)
