"""Direction of arrival: covariances by window and channel, Bartlett or Capon spectra, grid search with refinement.

What a window's samples come to is independent and is made in parallel: for Bartlett on a regular planar array the sums of the
covariance over pairs of elements with the same baseline (its lags), else the covariance. The search
runs through a shard's windows in order, because a window is searched around the estimate of the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.model import LIGHT_M_S, SearchConfig
from beamquarry.operators.beamform import by_window, payload_matrix, unpack_frames  # noqa: F401
from beamquarry.session import kept

COVARIANCE = "shard_id int, w long, f int, snapshots long, r binary"
LAGS = "shard_id int, w long, f int, snapshots long, lags binary"
ESTIMATE = "shard_id int, w long, l double, m double, n double, power double"


# --- relational form


def covariance_relational(samples: DataFrame, spectra: int) -> DataFrame:
    """(w, f, r, c, re, im): mean of x_r conj(x_c) over a window's spectra, by all pairs of a spectrum's samples.

    Samples are dealt by window, in the one shuffle; pairs are made and summed where their window is.
    """
    n_ant = 1 + (samples.agg(F.max("a")).first()[0] or 0)
    placed = by_window(samples.where("t IS NOT NULL AND f IS NOT NULL"), spectra, n_ant)
    held = placed.groupBy("w", "t", "f").agg(F.collect_list(F.struct("a", "re", "im")).alias("_s"))
    counted = held.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("w", "f")))  # a window's spectra at most
    pairs = counted.select("w", "f", "k", F.explode("_s").alias("x"), "_s").select("w", "f", "k", "x", F.explode("_s").alias("y"))
    re = F.sum(F.col("x.re") * F.col("y.re") + F.col("x.im") * F.col("y.im"))
    im = F.sum(F.col("x.im") * F.col("y.re") - F.col("x.re") * F.col("y.im"))
    return pairs.groupBy("w", "f", F.col("x.a").alias("r"), F.col("y.a").alias("c")).agg((re / F.first("k")).alias("re"), (im / F.first("k")).alias("im"))


def rls_fold(values: DataFrame, key: str, order: str, value: str, forgetting: float, block: int = 4096) -> DataFrame:
    """R_w = forgetting R_(w-1) + (1 - forgetting) B_w in order; the first window, or a factor of 1, replaces R.

    In two levels, as a step is a pair (decay, value) and pairs compose: blocks of `block` window numbers are folded apart, all in
    parallel, and what a block's last window leaves is carried over the blocks that follow, of which there are few. Windows may be missing.
    """
    if forgetting >= 1:
        return values.select(key, order, F.col(value).alias("folded"))
    kinds = dict(values.dtypes)
    rows = values.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).withColumn("_b", F.floor(F.col("_o") / block))

    def folds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, empty, fresh = None, 0, 0.0, 0.0
        for part in parts:
            out = []
            for k, b, v in zip(part["_k"].to_numpy(object), part["_b"].tolist(), part["_v"].tolist(), strict=True):
                if (k, b) != at:
                    at, n, empty, fresh = (k, b), 0, 0.0, v
                else:
                    fresh = forgetting * fresh + (1 - forgetting) * v
                empty, n = forgetting * empty + (1 - forgetting) * v, n + 1
                out.append((n, empty, fresh))
            yield part.assign(**{c: [x[i] for x in out] for i, c in enumerate(("_n", "_empty", "_fresh"))})

    def carries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, carry = object(), None
        for part in parts:
            out = []
            for k, n, empty, fresh in zip(part["_k"].to_numpy(object), part["_n"], part["_empty"], part["_fresh"], strict=True):
                if k != at:
                    at, carry = k, None
                out.append(carry)
                carry = fresh if carry is None else forgetting**n * carry + empty
            yield part[["_k", "_b"]].assign(_carry=pd.array(out, "Float64"))

    ordered = rows.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_o")
    local = kept(ordered.mapInPandas(folds, f"_k {kinds[key]}, _o {kinds[order]}, _v double, _b long, _n long, _empty double, _fresh double"), "folds")
    ends = local.groupBy("_k", "_b").agg(*[F.max_by(c, "_n").alias(c) for c in ("_n", "_empty", "_fresh")])
    carried = ends.repartition("_k").sortWithinPartitions("_k", "_b").mapInPandas(carries, f"_k {kinds[key]}, _b long, _carry double")
    carried = carried.select(F.col("_k").alias("_kk"), F.col("_b").alias("_bb"), "_carry")
    joined = local.join(carried, F.col("_k").eqNullSafe(F.col("_kk")) & (F.col("_b") == F.col("_bb")))
    whole = F.when(F.col("_carry").isNull(), F.col("_fresh")).otherwise(F.col("_empty") + F.pow(F.lit(forgetting), F.col("_n").cast("double")) * F.col("_carry"))
    return joined.select(F.col("_k").alias(key), F.col("_o").alias(order), whole.alias("folded"))


def bartlett_relational(samples: DataFrame, cells: DataFrame, channels: DataFrame, antennas: DataFrame, spectra: int) -> DataFrame:
    """(w, cell, power) over a fixed grid (cell, l, m, n): a^H R a is the mean over spectra of |sum of a* x|^2, summed over channels.

    Windows are independent, as no centre is carried. For checking: a row for each sample and cell.
    """
    from beamquarry.functions import scalars as S

    placed = samples.join(F.broadcast(channels), "f").join(F.broadcast(antennas), "a").crossJoin(F.broadcast(cells))  # bounded by the dimensions and the grid
    angle = S.phase(*(F.col(c) for c in ("hz", "x", "y", "z", "l", "m", "n")))
    sums = placed.withColumn("_phase", angle).groupBy("t", "f", "cell").agg(
        F.sum(F.cos("_phase") * F.col("re") - F.sin("_phase") * F.col("im")).alias("sr"), F.sum(F.cos("_phase") * F.col("im") + F.sin("_phase") * F.col("re")).alias("si")
    )
    by_channel = sums.groupBy(F.floor(F.col("t") / spectra).cast("long").alias("w"), "f", "cell").agg(F.avg(S.power(F.col("sr"), F.col("si"))).alias("power"))
    return by_channel.groupBy("w", "cell").agg(F.sum("power").alias("power"))


# --- NumPy kernels


@dataclass(frozen=True)
class Plane:
    """A planar array on a lattice: element a stands in column x[a] and row y[a], with pitches dx and dy from an origin."""

    x: tuple[int, ...]
    y: tuple[int, ...]
    nx: int
    ny: int
    dx: float
    dy: float
    origin: tuple[float, float, float]

    @classmethod
    def of(cls, positions: np.ndarray) -> Plane | None:
        """None unless all elements lie in one plane of z, in evenly spaced columns and rows, one at a place."""
        places = np.round(np.asarray(positions, float), 9)
        if len(places) < 2 or np.ptp(places[:, 2]) > 0:
            return None
        (columns, x), (rows, y) = (np.unique(places[:, k], return_inverse=True) for k in (0, 1))
        pitches = [np.diff(c) for c in (columns, rows)]
        if any(len(d) and not np.allclose(d, d[0], rtol=0, atol=1e-8) for d in pitches) or len({*zip(x, y, strict=True)}) < len(places):
            return None
        dx, dy = (float(d[0]) if len(d) else 0.0 for d in pitches)
        return cls(tuple(x.tolist()), tuple(y.tolist()), len(columns), len(rows), dx, dy, tuple(places.min(axis=0).tolist()))


def covariance(x: np.ndarray, subarray: int = 0, kind: type = np.complex64) -> np.ndarray:
    """Mean of x x^H over spectra (rows of x); with a sub-array size, averaged over sub-arrays in index order, forward and backward."""
    x, count = x.astype(kind), kind(len(x)).real
    if not subarray or subarray == x.shape[1]:
        return x.T @ x.conj() / count
    parts = np.lib.stride_tricks.sliding_window_view(x, subarray, axis=1)
    r = np.einsum("ksi,ksj->ij", parts, parts.conj()) / (count * kind(parts.shape[1]).real)
    return ((r + r[::-1, ::-1].conj()) / 2).astype(kind)


def loaded(r: np.ndarray, load: float) -> np.ndarray:
    return r + np.eye(len(r), dtype=r.dtype) * (load * np.trace(r).real / len(r))


def powers(base: np.ndarray, n: int) -> np.ndarray:
    """1, base, base^2, ... up to n of them, along a new last axis: each is the one before times base."""
    steps = np.repeat(base[..., None], n, axis=-1)
    steps[..., 0] = 1
    return steps.cumprod(axis=-1)


def steering(hz: np.ndarray, positions: np.ndarray, look: np.ndarray) -> np.ndarray:
    """[f][cell][a]: the phases that a source at each cell leaves on the elements (its conjugate steers).

    On a lattice an element's phase is a power of a column's times a power of a row's, so two exponentials a cell do; else
    there is one for each element and cell.
    """
    k = -2 * np.pi / LIGHT_M_S * hz[:, None]
    plane = Plane.of(positions)
    if plane is None:
        return np.exp(1j * k[..., None] * (look @ positions.T)).astype(np.complex64)
    columns, rows = (powers(np.exp(1j * k * d * look[:, c]), n) for c, d, n in ((0, plane.dx, plane.nx), (1, plane.dy, plane.ny)))
    start = np.exp(1j * k * (look @ np.array(plane.origin)))
    return (start[..., None] * columns[..., plane.x] * rows[..., plane.y]).astype(np.complex64)


def inverse_factors(r: np.ndarray, load: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of the Cholesky factors of loaded covariances [f][i][j], and which channels have one."""
    out, good = np.zeros_like(r), np.zeros(len(r), bool)
    for f, rf in enumerate(r):
        try:
            out[f] = np.linalg.inv(np.linalg.cholesky(loaded(rf, load)))
            good[f] = True
        except np.linalg.LinAlgError:
            pass
    return out, good


def cell_powers(r: np.ndarray, a: np.ndarray, inverse: np.ndarray | None = None, good: np.ndarray | None = None) -> np.ndarray:
    """[f][cell] of covariances [f][i][j] and steering [f][cell][a]; values that are not finite count as 0.

    Bartlett is a^H R a. Capon is 1 / |L^-1 a|^2 with the inverse factors given, and falls back to Bartlett in channels where there is none.
    """
    found = np.empty(a.shape[:2])
    plain = np.ones(len(r), bool) if inverse is None else ~good
    if plain.any():
        found[plain] = ((a[plain].conj() @ r[plain]) * a[plain]).sum(axis=-1).real
    if not plain.all():
        y = a[~plain] @ inverse[~plain].transpose(0, 2, 1)
        with np.errstate(divide="ignore"):
            found[~plain] = 1 / (y.real**2 + y.imag**2).sum(axis=-1)
    return np.where(np.isfinite(found), found, 0)


def spectrum(r: np.ndarray, a: np.ndarray, estimator: str, load: float) -> np.ndarray:
    """Power of each cell, summed over channels."""
    return cell_powers(r, a, *(inverse_factors(r, load) if estimator == "capon" else ())).sum(axis=0)


def lag_powers(lags: np.ndarray, hz: np.ndarray, plane: Plane, look: np.ndarray) -> np.ndarray:
    """[f][cell] of lag sums [f][row lag][column lag]: a^H R a, in which pairs with one baseline share their phase."""
    u, v = (lag_phases(hz, d, n, look[:, c]) for c, d, n in ((0, plane.dx, plane.nx), (1, plane.dy, plane.ny)))
    return ((v @ lags) * u).sum(axis=-1).real


def lag_phases(hz: np.ndarray, pitch: float, n: int, cosines: np.ndarray) -> np.ndarray:
    """[f][cell][lag] for lags from 1 - n to n - 1."""
    forward = powers(np.exp(2j * np.pi / LIGHT_M_S * hz[:, None] * pitch * cosines), n)
    return np.concatenate([forward[..., :0:-1].conj(), forward], axis=-1)


class MatrixScan:
    """Power around one window's covariances [f][i][j]; what Capon needs of them is computed once for all cells."""

    def __init__(self, r: np.ndarray, hz: np.ndarray, positions: np.ndarray, config: SearchConfig):
        self.r, self.hz, self.positions = r, hz, positions[: r.shape[1]]
        self.factors = inverse_factors(r, config.diagonal_load) if config.estimator == "capon" else ()

    def grid(self, l_axis: np.ndarray, m_axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and powers of all pairs of cosines, l running fastest."""
        look = in_disk(cells_of(l_axis, m_axis))
        return look, cell_powers(self.r, steering(self.hz, self.positions, look), *self.factors).sum(axis=0)


class LagScan:
    """The same for lag sums [f][row lag][column lag] of a regular array. Where no cell is pulled into the disk, the sums over both axes are two matrix products."""

    def __init__(self, lags: np.ndarray, hz: np.ndarray, positions: np.ndarray, config: SearchConfig):
        self.lags, self.hz, self.plane = lags, hz, Plane.of(positions)

    def grid(self, l_axis: np.ndarray, m_axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = cells_of(l_axis, m_axis)
        look, p = in_disk(cells), self.plane
        if (look[:, :2] != cells).any():
            power = lag_powers(self.lags, self.hz, p, look)
        else:
            u, v = lag_phases(self.hz, p.dx, p.nx, l_axis), lag_phases(self.hz, p.dy, p.ny, m_axis)
            power = (v @ self.lags @ u.transpose(0, 2, 1)).real.reshape(len(self.hz), -1)
        return look, np.where(np.isfinite(power), power, 0).sum(axis=0)


def cells_of(l_axis: np.ndarray, m_axis: np.ndarray) -> np.ndarray:
    return np.stack([np.tile(l_axis, len(m_axis)), np.repeat(m_axis, len(l_axis))], axis=1)


def uses_lags(positions: np.ndarray, config: SearchConfig) -> bool:
    """Whether a search needs no more than sums over pairs of one baseline."""
    return config.estimator == "bartlett" and config.subarray in (0, len(positions)) and Plane.of(positions) is not None


def in_disk(lm: np.ndarray) -> np.ndarray:
    """Directions (l, m, n) of (l, m), pulled to radius^2 0.999 where they lie beyond."""
    r2 = (lm**2).sum(axis=-1, keepdims=True)
    lm = np.where(r2 > 0.999, lm * np.sqrt(0.999 / np.maximum(r2, 1e-30)), lm)
    return np.concatenate([lm, np.sqrt(1 - (lm**2).sum(axis=-1, keepdims=True))], axis=-1)


def parabola(below: float, centre: float, above: float, kind: str) -> float:
    """Offset towards the greater neighbour, within half a cell. "corrected" goes to the vertex of a peak (concave points); "reference" moves
    by the same rule, but only where the points are convex."""
    curve = below - 2 * centre + above
    if (curve <= 0) if kind == "reference" else (curve >= 0):
        return 0.0
    return float(np.clip(0.5 * (above - below) / abs(curve), -0.5, 0.5))


def search(scan: MatrixScan | LagScan, centre: np.ndarray, config: SearchConfig) -> tuple[np.ndarray, float]:
    """The direction of most power near a centre: coarse grid, then 3 x 3 neighbourhoods of half the pitch each time."""
    g, fov = config.grid, np.array([config.fov_l, config.fov_m])
    step = 2 * fov / (g - 1)
    look, power = scan.grid(*(centre[c] - fov[c] + np.arange(g) * step[c] for c in (0, 1)))
    best = int(power.argmax())
    here, peak, half = look[best], float(power[best]), fov / g
    if config.interpolate and config.levels == 0:
        grid = np.pad(power.reshape(g, g), 1)
        y, x = best // g + 1, best % g + 1
        move = [parabola(grid[y, x - 1], peak, grid[y, x + 1], config.interpolation), parabola(grid[y - 1, x], peak, grid[y + 1, x], config.interpolation)]
        return in_disk(here[:2] + np.array(move) * step), peak
    for _ in range(config.levels):
        half = half / 2
        look, power = scan.grid(*(here[c] + np.arange(-1, 2) * half[c] for c in (0, 1)))
        best = int(power.argmax())
        here, peak = look[best], float(power[best])
        if config.interpolate:
            move = [parabola(power[3], power[4], power[5], config.interpolation), parabola(power[1], power[4], power[7], config.interpolation)]
            if config.interpolation == "corrected" and best != 4:
                move = [0.0, 0.0]
            here = in_disk(here[:2] + np.array(move) * half)
    return here, peak


class Memory:
    """Covariance of each channel, carried from window to window with forgetting."""

    def __init__(self, forgetting: float, r: dict[int, np.ndarray] | None = None):
        self.forgetting, self.r = forgetting, r or {}

    def update(self, f: int, fresh: np.ndarray) -> np.ndarray:
        old = self.r.get(f)
        self.r[f] = fresh if old is None or self.forgetting >= 1 else self.forgetting * old + (1 - self.forgetting) * fresh
        return self.r[f]


# --- frame form


def covariances(frames: DataFrame, n_ant: int, spectra: int, subarray: int = 0, kind: type = np.complex64) -> DataFrame:
    """(shard_id, w, f, snapshots, r): at most `spectra` frames for each window and channel, so lists are bounded; many keys in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["frames"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = unpack_frames(payload_matrix(lists.flatten(), n_ant))
            found = [covariance(x[a:b], subarray, kind).astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch["shard_id"], batch["w"], batch["f"], pa.array(np.diff(ends).astype(np.int64)), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard_id", "w", "f", "snapshots", "r"])

    keyed = frames.withColumn("w", F.floor(F.col("t") / spectra).cast("long"))
    return keyed.groupBy("shard_id", "w", "f").agg(F.collect_list("payload").alias("frames")).mapInArrow(run, COVARIANCE)


def lag_sums(frames: DataFrame, positions: np.ndarray, spectra: int, slice_rows: int = 2048) -> DataFrame:
    """(shard_id, w, f, snapshots, lags) of a regular planar array: for each baseline the sum of mean x_i conj(x_j) over its pairs.

    These are the autocorrelation of the array's samples on a lattice of twice its size, so |FFT|^2 is all that a spectrum
    adds. Each task sums what it has of a window and channel before the shuffle, in which a key has a row for each batch at most.
    """
    plane = Plane.of(np.asarray(positions, float))
    if plane is None:
        raise ValueError("lags need a regular planar array")
    shape = (2 * plane.ny, 2 * plane.nx)
    names = ["shard_id", "w", "f", "snapshots", "power"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, inverse, count = np.unique(np.stack([batch[c].to_numpy() for c in ("shard_id", "w", "f")]), axis=1, return_inverse=True, return_counts=True)
            inverse, payload = inverse.ravel(), payload_matrix(batch["payload"], len(plane.x))
            sums = np.zeros((key.shape[1], *shape))
            for low in range(0, len(payload), slice_rows):
                x = unpack_frames(payload[low : low + slice_rows])
                grid = np.zeros((len(x), *shape), np.complex128)
                grid[:, plane.y, plane.x] = x
                seen = np.fft.fft2(grid)
                np.add.at(sums, inverse[low : low + slice_rows], seen.real**2 + seen.imag**2)
            columns = [pa.array(key[0].astype(np.int32)), pa.array(key[1].astype(np.int64)), pa.array(key[2].astype(np.int32)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sums], pa.binary())], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = np.arange(1 - plane.ny, plane.ny), np.arange(1 - plane.nx, plane.nx)
        for batch in batches:
            found = []
            for parts, n in zip(batch["power"].to_pylist(), batch["snapshots"].to_pylist(), strict=True):
                power = sum(np.frombuffer(x).reshape(shape) for x in parts) / n
                found.append(np.fft.ifft2(power)[np.ix_(rows, columns)].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:4]), pa.array(found, pa.binary())], [*names[:4], "lags"])

    keyed = frames.select(F.col("shard_id").cast("int").alias("shard_id"), F.floor(F.col("t") / spectra).cast("long").alias("w"), F.col("f").cast("int").alias("f"), "payload")
    parts = keyed.mapInArrow(partial, "shard_id int, w long, f int, snapshots long, power binary")
    sums = parts.groupBy("shard_id", "w", "f").agg(F.sum("snapshots").alias("snapshots"), F.collect_list("power").alias("power"))
    return sums.mapInArrow(total, LAGS)


def _matrix(raw: bytes, kind: type = np.complex64) -> np.ndarray:
    size = math.isqrt(len(raw) // np.dtype(kind).itemsize)
    return np.frombuffer(raw, kind).reshape(size, size)


def covariance_rows(covs: DataFrame, kind: type = np.complex64) -> DataFrame:
    """(shard_id, w, f, r, c, re, im): the entries of covariances as rows, n_ant squared for a window and channel, not for a spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a batch of one matrix each
                m = _matrix(batch["r"][i].as_py(), kind)
                r, c = np.divmod(np.arange(m.size, dtype=np.int32), len(m))
                keys = [pa.array(np.full(m.size, batch[k][i].as_py()), batch[k].type) for k in ("shard_id", "w", "f")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(r), pa.array(c), pa.array(m.real.ravel().astype(float)), pa.array(m.imag.ravel().astype(float))], ["shard_id", "w", "f", "r", "c", "re", "im"])

    return covs.mapInArrow(run, "shard_id int, w long, f int, r int, c int, re double, im double")


def scanner(column: str, positions: np.ndarray, config: SearchConfig) -> tuple[Callable, Callable]:
    """How a value of the column `r` or `lags` is read, and what scans a window's values."""
    if column == "r":
        return _matrix, lambda values, hz: MatrixScan(values, hz, positions, config)
    plane = Plane.of(positions)
    return lambda raw: np.frombuffer(raw, np.complex128).reshape(2 * plane.ny - 1, 2 * plane.nx - 1), lambda values, hz: LagScan(values, hz, positions, config)


def observed(frames: DataFrame, positions: np.ndarray, config: SearchConfig) -> DataFrame:
    """What a search of these settings reads: lag sums where they are enough, else covariances."""
    positions = np.asarray(positions, float)
    if uses_lags(positions, config):
        return lag_sums(frames, positions, config.spectra)
    return covariances(frames, len(positions), config.spectra, config.subarray)


def estimate(values: DataFrame, hz: np.ndarray, positions: np.ndarray, config: SearchConfig) -> DataFrame:
    """(shard_id, w, l, m, n, power) of covariances or lag sums: a shard's windows in order, one window in memory at a time.

    Shards are the only parallel unit here, as in any search that starts from the last estimate; what it reads
    is one value for each window and channel, not the samples.
    """
    hz, positions = np.asarray(hz, float), np.asarray(positions, float)
    config.check(len(positions))
    column = "lags" if "lags" in values.columns else "r"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, scan = scanner(column, positions, config)
        shard, memory, centre, window, held = None, None, None, None, {}

        def close():
            nonlocal centre
            fs = sorted(held)
            centre, power = search(scan(np.stack([memory.update(f, held[f]) for f in fs]), hz[fs]), centre, config)
            return [shard, window, *centre, power]

        for part in parts:
            out = []
            for s, w, f, raw in zip(part["shard_id"], part["w"], part["f"], part[column], strict=True):
                if (s, w) != (shard, window):
                    if held:
                        out.append(close())
                    if s != shard:
                        shard, memory = s, Memory(config.forgetting)
                        centre = np.array(config.prior.at(0))
                    window, held = w, {}
                held[f] = decode(raw)
            yield pd.DataFrame(out, columns=["shard_id", "w", "l", "m", "n", "power"])
        if held:
            yield pd.DataFrame([close()], columns=["shard_id", "w", "l", "m", "n", "power"])

    shards = values.repartition("shard_id").sortWithinPartitions("shard_id", "w", "f")
    return shards.mapInPandas(run, ESTIMATE)


def grid_powers(values: DataFrame, hz: np.ndarray, positions: np.ndarray, look: np.ndarray, estimator: str = "bartlett", load: float = 1e-2, kind: type = np.complex64) -> DataFrame:
    """(shard_id, w, cell, power): spectra of covariances or (Bartlett) lag sums over a fixed grid look[cell], without a carried centre: windows and channels are all parallel.

    Steering is computed once for each channel of a batch.
    """
    hz, positions, look = (np.asarray(x, float) for x in (hz, positions, look))
    plane = Plane.of(positions) if "lags" in values.columns else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = np.empty((len(part), len(look)))
            for f, rows in part.groupby("f").indices.items():
                if plane:
                    lags = np.stack([np.frombuffer(x, np.complex128).reshape(2 * plane.ny - 1, 2 * plane.nx - 1) for x in part["lags"].iloc[rows]])
                    found[rows] = lag_powers(lags, hz[[f]], plane, look)
                else:
                    r = np.stack([_matrix(x, kind) for x in part["r"].iloc[rows]])
                    a = steering(hz[[f]], positions[: r.shape[1]], look)
                    found[rows] = cell_powers(r, np.broadcast_to(a, (len(r), *a.shape[1:])), *(inverse_factors(r, load) if estimator == "capon" else ()))
            yield pd.DataFrame({"shard_id": part["shard_id"], "w": part["w"], "power": list(found)})

    rows = values.mapInPandas(run, "shard_id int, w long, power array<double>").select("shard_id", "w", F.posexplode("power").alias("cell", "power"))
    return rows.groupBy("shard_id", "w", "cell").agg(F.sum("power").alias("power"))


def dump(covs: DataFrame, cells: DataFrame, powers: DataFrame, path: str) -> None:
    """What a search saw, for a look at it afterwards: covariances, cells and powers as tables under one folder."""
    for name, table in (("covariances", covs), ("cells", cells), ("powers", powers)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def strongest_cell(powers: DataFrame, cells: DataFrame) -> DataFrame:
    """(shard_id, w, l, m, n, power): the first of the strongest cells of each window."""
    best = powers.groupBy("shard_id", "w").agg(F.max(F.struct("power", (-F.col("cell")).alias("minus"))).alias("_m"))
    return best.select("shard_id", "w", (-F.col("_m.minus")).alias("cell"), F.col("_m.power").alias("power")).join(F.broadcast(cells), "cell").drop("cell")


def emit(frames: DataFrame, estimates: DataFrame, hz: np.ndarray, positions: np.ndarray, spectra: int) -> DataFrame:
    """(shard_id, t, f, power): the beam at each window's estimate; estimates are joined by (shard, window)."""
    hz, positions = np.asarray(hz, float), np.asarray(positions, float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = unpack_frames(np.frombuffer(b"".join(part["payload"]), np.uint8).reshape(len(part), len(positions)))
            look = part[["l", "m", "n"]].to_numpy()
            angle = 2 * np.pi / LIGHT_M_S * hz[part["f"].to_numpy()][:, None] * (look @ positions.T)
            y = np.einsum("ra,ra->r", x, np.exp(1j * angle))
            yield pd.DataFrame({"shard_id": part["shard_id"], "t": part["t"], "f": part["f"], "power": y.real**2 + y.imag**2})

    keyed = frames.withColumn("w", F.floor(F.col("t") / spectra).cast("long")).join(estimates.select("shard_id", "w", "l", "m", "n"), ["shard_id", "w"])
    return keyed.select("shard_id", "t", "f", "payload", "l", "m", "n").mapInPandas(run, "shard_id int, t long, f int, power double")


def run(frames: DataFrame, hz: np.ndarray, positions: np.ndarray, config: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """(estimates, power). Without a grid (size 0 or 1) there is no search, and the prior path is tracked."""
    from beamquarry.operators import tracker

    if config.grid <= 1:
        windows = frames.select("shard_id", F.floor(F.col("t") / config.spectra).cast("long").alias("w")).distinct()
        steered = tracker.steer(windows, config.prior, config.spectra).withColumn("power", F.lit(None).cast("double"))
        return steered, emit(frames, steered, hz, positions, config.spectra)
    found = estimate(observed(frames, positions, config), hz, positions, config)
    return found, emit(frames, found, hz, positions, config.spectra)
