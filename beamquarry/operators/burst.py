"""Dispersed bursts: synthesis, dedispersion, signal-to-noise, trial sweeps and fits.

Sampling, band and reference frequency are always explicit arguments. A waterfall is (t, f, power)
with t from 0 to n_time - 1; rows that are missing count as zero power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S

#: Name, dispersion measure, arrival s, width s, scattering s at 400 MHz, spectral index, running, target S/N.
CATALOG = (
    ("FRB20180916B_canonical", 348.82, 8.064, 0.0015, 0.0020, -1.2, -0.4, 25.0),
    ("High_DM_Burst", 1205.40, 8.064, 0.0020, 0.0040, -2.0, 0.0, 20.0),
    ("Scattering_Dominated", 574.10, 8.064, 0.0010, 0.0120, -1.5, -0.8, 18.0),
    ("Faint_Narrow_Pulse", 412.30, 8.064, 0.0008, 0.0005, 0.5, -1.0, 9.5),
)
CATALOG_SCHEMA = (
    "name string, dm double, arrival_time_s double, width_s double, scattering_tau_s double, spectral_index double, spectral_running double, target_snr double"
)
#: Bounds of a fit beside the peak's: s around the peak, narrowest and widest width, most scattering, lowest background.
FIT_REACH_S, FIT_WIDTH_S, FIT_TAU_S, FIT_BACKGROUND, FIT_GAIN = 0.5, (1e-4, 0.05), 0.05, -100.0, 5.0
#: What a recovery may miss (arrival s, width s), the share of the target S/N, the dispersion measure, the scaling slope.
MISS_ARRIVAL_S, MISS_WIDTH_S, SNR_SHARE, MISS_DM, SLOPES = 0.010, 0.002, 0.70, 5.0, (0.40, 0.60)
#: Offsets from the boresight in l, of which the first four must fall; antennas of the scaling test.
OFFSETS, SCALING_ANTENNAS = (0.0, 0.005, 0.010, 0.015, 0.020, 0.025), (32, 64)
#: Samples a second, lowest scattering that is convolved, noise of one component, sweep steps and half-range.
SAMPLE_RATE_HZ, LEAST_TAU_S, NOISE_SIGMA, SWEEP_STEPS, SWEEP_RANGE = 952.381, 1e-6, 1.5, 51, 0.4


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), CATALOG_SCHEMA)


def benchmark_burst(spark: SparkSession, name: str) -> DataFrame:
    found = catalog(spark).where(F.col("name") == name)
    if name not in {x[0] for x in CATALOG}:
        raise KeyError(name)
    return found


# --- synthesis


def pulse(t: np.ndarray, centre: float, sigma: float, tau: float, dt: float) -> np.ndarray:
    """A Gaussian convolved with a one-sided exponential of unit sum, on the same samples (centred)."""
    gauss = np.exp(-0.5 * ((t - centre) / sigma) ** 2)
    if tau <= LEAST_TAU_S:
        return gauss
    k = np.exp(-np.arange(min(len(t), int(8 * tau / dt) + 1)) * dt / tau)
    full = np.convolve(gauss, k / k.sum())
    low = (min(len(t), len(k)) - 1) // 2
    return full[low : low + max(len(t), len(k))][: len(t)]


def synthesize(channels: DataFrame, burst: tuple, n_time: int, rate_hz: float = SAMPLE_RATE_HZ, ref_hz: float = 800e6) -> DataFrame:
    """(t, f, power): each channel by itself, so channels spread over tasks."""
    _, dm, arrival, width, tau_400, index, running, _ = burst
    dt = 1 / rate_hz

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(n_time) * dt
        for part in parts:
            for f, hz, law, delay in zip(part["f"], part["hz"], part["law"], part["delay"], strict=True):
                power = law * pulse(t, arrival + delay, width, tau_400 * (hz / 4e8) ** -4.0, dt)
                yield pd.DataFrame({"t": np.arange(n_time), "f": np.int32(f), "power": power})

    spread = channels.sparkSession.sparkContext.defaultParallelism
    laws = S.spectral_law(F.col("hz"), F.lit(index), F.lit(running), ref_hz), S.dispersion_delay(F.lit(dm), F.col("hz"), ref_hz)
    return channels.select("f", "hz", laws[0].alias("law"), laws[1].alias("delay")).repartition(spread).mapInPandas(run, "t long, f int, power double")


def with_noise(waterfall: DataFrame, level: float, seed: int = 1) -> DataFrame:
    """Add uniform noise up to `level`, by (seed, t, f) alone; without any, a baseline has no spread and S/N is 0."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "t", "f"), F.lit(1 << 20)) / float(1 << 20)
    return waterfall.withColumn("power", F.col("power") + draw * level)


def voltages(waterfall: DataFrame, channels: DataFrame, positions: np.ndarray, direction: tuple[float, float], snr: float, peak: float, seed: int = 42, sign: int = 1, ref_ant: int = 64) -> DataFrame:
    """(t, f, payload): sqrt of power with the source's phases, Gaussian noise, rounded half to even and clipped to [-7, 7].

    `sign` is that of the phase: +1 here, -1 in the deterministic generators. Noise depends on (seed, t, f) alone,
    so it does not change with the partitions.
    """
    l, m = direction  # noqa: E741
    look = np.array([l, m, np.sqrt(max(0.0, 1 - l * l - m * m))])
    reach = np.asarray(positions, float) @ look * (2 * np.pi / S.LIGHT_M_S)
    scale = snr * NOISE_SIGMA / (np.sqrt(ref_ant) * np.sqrt(peak if peak > 0 else 1.0))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            amp = np.sqrt(np.maximum(part["power"].to_numpy(), 0)) * scale
            x = amp[:, None] * np.exp(sign * 1j * part["hz"].to_numpy()[:, None] * reach)
            noise = np.array([np.random.default_rng((seed, int(t), int(f))).standard_normal((len(reach), 2)) for t, f in zip(part["t"], part["f"], strict=True)])
            parts_ = [np.clip(np.rint(y + NOISE_SIGMA * n), -7, 7).astype(np.int8) for y, n in ((x.real, noise[:, :, 0]), (x.imag, noise[:, :, 1]))]
            packed = ((parts_[0] & 15) | ((parts_[1] & 15) << 4)).astype(np.uint8)
            yield pd.DataFrame({"t": part["t"], "f": part["f"], "payload": [row.tobytes() for row in packed]})

    return waterfall.join(F.broadcast(channels), "f").mapInPandas(run, "t long, f int, payload binary")


# --- dedispersion


def shifts(channels: DataFrame, trials: DataFrame, rate_hz: float = SAMPLE_RATE_HZ, ref_hz: float = 800e6) -> DataFrame:
    """(trial, f, shift): whole samples, half to even, for each trial (trial, dm). Trials times channels is bounded by both arguments."""
    delay = S.dispersion_delay(F.col("dm"), F.col("hz"), ref_hz)
    return trials.crossJoin(F.broadcast(channels)).select("trial", "dm", "f", F.rint(delay * rate_hz).cast("long").alias("shift"))


def dedisperse(waterfall: DataFrame, shift: DataFrame, n_time: int, wrap: bool = True) -> DataFrame:
    """(trial, t, f, power): each sample moves back by its channel's shift, around the end or (wrap=False) off it."""
    moved = waterfall.join(F.broadcast(shift), "f").withColumn("_at", F.col("t") - F.col("shift"))
    if not wrap:
        moved = moved.where((F.col("_at") >= 0) & (F.col("_at") < n_time))
    return moved.select("trial", F.pmod(F.col("_at"), F.lit(n_time)).alias("t"), "f", "power")


def profile(dedispersed: DataFrame, n_time: int) -> DataFrame:
    """(trial, t, power): summed over channels, with zeros where nothing arrived."""
    return on_axis(dedispersed.groupBy("trial", "t").agg(F.sum("power").alias("power")), n_time)


def on_axis(sums: DataFrame, n_time: int) -> DataFrame:
    axis = sums.select("trial").distinct().select("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_time - 1).cast("long"))).alias("t"))
    return axis.join(sums, ["trial", "t"], "left").select("trial", "t", F.coalesce("power", F.lit(0)).alias("power"))


#: Shifts (trials times channels) up to which a tree of shared profiles is looked for, and the groups of channels that are tried.
MOST_SHIFTS, FANOUTS = 4_000_000, (2, 4, 8, 16)


def shift_tree(shift: np.ndarray, fanout: int) -> list[list[tuple[int, int, int, int, int]]]:
    """Levels of (group, pattern, group above, pattern above, offset) of shifts [trial][channel]; the last level's pattern above is the trial.

    Within a group of channels only the shifts relative to its first channel matter. Trials in which these are the same have one
    pattern, and one partial profile; a group above puts those of its groups together, each moved by a constant.
    """
    n_trials, n = shift.shape
    groups, pattern, levels = [[f] for f in range(n)], [np.zeros(n_trials, int)] * n, []
    while len(groups) > fanout:
        level, above, patterns = [], [], []
        for number, low in enumerate(range(0, len(groups), fanout)):
            members = range(low, min(low + fanout, len(groups)))
            channels = [f for g in members for f in groups[g]]
            anchor = channels[0]
            _, first, kind = np.unique(shift[:, channels] - shift[:, [anchor]], axis=0, return_index=True, return_inverse=True)
            level += [(g, int(pattern[g][t]), number, k, int(shift[t, groups[g][0]] - shift[t, anchor])) for k, t in enumerate(first) for g in members]
            above.append(channels)
            patterns.append(kind.ravel())
        groups, pattern = above, patterns
        levels.append(level)
    levels.append([(g, int(pattern[g][t]), 0, t, int(shift[t, groups[g][0]])) for t in range(n_trials) for g in range(len(groups))])
    return levels


def best_tree(shift: np.ndarray, fanouts: tuple[int, ...] = FANOUTS) -> list[list[tuple[int, int, int, int, int]]]:
    """The levels that move the fewest rows for a sample of time; one level is the sum over channels for each trial by itself."""
    trees = [shift_tree(shift, shift.shape[1]), *(shift_tree(shift, k) for k in fanouts if k < shift.shape[1])]
    return min(trees, key=lambda levels: sum(map(len, levels)))


def shared_profiles(waterfall: DataFrame, shift: DataFrame, n_time: int, wrap: bool = True) -> DataFrame:
    """(trial, t, power): the profiles of dedisperse(), exactly, from partial profiles that trials share.

    The shifts come to the driver, trials times channels of them; each level's mapping is no larger and is broadcast.
    """
    table = shift.select("trial", "f", "shift").limit(MOST_SHIFTS + 1).toPandas()
    if len(table) > MOST_SHIFTS:
        return profile(dedisperse(waterfall, shift, n_time, wrap), n_time)
    grid = table.pivot(index="trial", columns="f", values="shift")
    levels = best_tree(grid.to_numpy())
    if len(levels) == 1:  # nothing to share
        return profile(dedisperse(waterfall, shift, n_time, wrap), n_time)
    trials, channels = grid.index.tolist(), grid.columns.tolist()
    spark = waterfall.sparkSession
    names = spark.createDataFrame([(f, g) for g, f in enumerate(channels)], "f int, _g int")
    rows = waterfall.join(F.broadcast(names), "f").select("_g", F.lit(0).alias("_p"), "t", "power")
    for number, level in enumerate(levels):
        last = number == len(levels) - 1
        moved = rows.join(F.broadcast(spark.createDataFrame(level, "_g int, _p int, _above int, _to int, _offset long")), ["_g", "_p"])
        at = F.col("t") - F.col("_offset")
        if wrap:
            at = F.pmod(at, F.lit(n_time))
        rows = moved.select(F.col("_above").alias("_g"), F.col("_to").alias("_p"), at.alias("t"), "power")
        if last and not wrap:
            rows = rows.where((F.col("t") >= 0) & (F.col("t") < n_time))
        rows = rows.groupBy("_g", "_p", "t").agg(F.sum("power").alias("power"))
    which = spark.createDataFrame(list(enumerate(trials)), "_p int, trial int")
    return on_axis(rows.join(F.broadcast(which), "_p").select("trial", "t", "power"), n_time)


def profile_snr(profiles: DataFrame, n_time: int) -> DataFrame:
    """(trial, peak_t, baseline_mean, baseline_std, snr): the first maximum over what lies outside of it and its surroundings.

    The surroundings are 5 % of the samples on each side, 10 at least; if nothing is left, all samples are the baseline.
    """
    wide = max(10, int(0.05 * n_time))
    x = F.col("power").cast("double")
    peaks = profiles.groupBy("trial").agg(F.max(F.struct(x.alias("p"), (-F.col("t")).alias("minus"))).alias("_m"))
    peaks = peaks.select("trial", (-F.col("_m.minus")).alias("peak_t"), F.col("_m.p").alias("peak"))
    away = (F.col("t") < F.col("peak_t") - wide) | (F.col("t") >= F.col("peak_t") + wide)
    base = profiles.join(peaks, "trial").groupBy("trial", "peak_t", "peak").agg(
        F.avg(F.when(away, x)).alias("_m1"), F.stddev_pop(F.when(away, x)).alias("_s1"), F.avg(x).alias("_m0"), F.stddev_pop(x).alias("_s0")
    )
    mean, std = F.coalesce("_m1", "_m0"), F.coalesce("_s1", "_s0")
    snr = F.when(std <= 1e-12, 0.0).otherwise((F.col("peak") - mean) / F.when(std > 1e-12, std))
    return base.select("trial", "peak_t", mean.alias("baseline_mean"), std.alias("baseline_std"), snr.alias("snr"))


def trial_table(spark: SparkSession, dm: float, steps: int = SWEEP_STEPS, reach: float = SWEEP_RANGE) -> DataFrame:
    """(trial, dm): evenly spaced around a dispersion measure."""
    low, high = max(0.0, dm * (1 - reach)), dm * (1 + reach)
    step = (high - low) / max(1, steps - 1)
    return spark.range(0, steps, 1, 1).select(F.col("id").cast("int").alias("trial"), (low + F.col("id") * step).alias("dm"))


def sweep(waterfall: DataFrame, channels: DataFrame, trials: DataFrame, n_time: int, rate_hz: float = SAMPLE_RATE_HZ, ref_hz: float = 800e6, wrap: bool = True) -> DataFrame:
    """(trial, dm, peak_t, snr) of all trials: one pass over the waterfall, in which trials share what they have in common."""
    found = profile_snr(shared_profiles(waterfall, shifts(channels, trials, rate_hz, ref_hz), n_time, wrap), n_time)
    return found.join(F.broadcast(trials), "trial").select("trial", "dm", "peak_t", "snr")


def best_trial(swept: DataFrame) -> DataFrame:
    return swept.agg(F.max_by(F.struct("trial", "dm", "snr"), F.struct("snr", -F.col("trial"))).alias("_b")).select("_b.*")


# --- fits


def channel_powers(dedispersed: DataFrame, peak_t: int, baseline: float, n_time: int, n_freq: int) -> DataFrame:
    """(f, power): mean around the peak (1 % of the samples on each side, 5 at least) less the channel's share of the baseline."""
    wide = max(5, int(0.01 * n_time))
    low, high = max(0, peak_t - wide), min(n_time, peak_t + wide)
    near = dedispersed.where((F.col("t") >= low) & (F.col("t") < high))
    return near.groupBy("f").agg(F.greatest(F.sum("power") / (high - low) - baseline / n_freq, F.lit(1e-6)).alias("power"))


def spectral_index(powers: DataFrame, channels: DataFrame, ref_hz: float = 800e6) -> DataFrame:
    log = powers.join(F.broadcast(channels), "f").select(F.log(F.col("hz") / ref_hz).alias("x"), F.log("power").alias("y"))
    return log.agg(F.regr_slope("y", "x").alias("spectral_index"))


def fit_pulse(t: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200) -> tuple[np.ndarray, bool]:
    """Bounded Levenberg-Marquardt fit of (amplitude, centre, width, scattering, background); the start and False if it fails."""
    dt = t[1] - t[0] if len(t) > 1 else 1e-3

    def model(p: np.ndarray) -> np.ndarray:
        return p[0] * pulse(t, p[1], max(p[2], 1e-5), p[3] if p[3] > 1e-5 else 0.0, dt) + p[4]

    p = np.clip(np.asarray(start, float), low, high)
    error, damp = model(p) - y, 1e-3
    cost = float(error @ error)
    if not np.isfinite(cost):
        return np.asarray(start, float), False
    for _ in range(steps):
        move = np.maximum(np.abs(p), 1e-6) * 1e-6
        jac = np.stack([(model(p + move[k] * (np.arange(5) == k)) - (error + y)) / move[k] for k in range(5)], axis=1)
        normal, slope = jac.T @ jac, jac.T @ error
        try:
            new = np.clip(p - np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), slope), low, high)
        except np.linalg.LinAlgError:
            return np.asarray(start, float), False
        trial = model(new) - y
        if (now := float(trial @ trial)) < cost:
            done = cost - now <= 1e-12 * cost
            p, error, cost, damp = new, trial, now, damp / 5
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, True


def fit_profiles(profiles: DataFrame, snrs: DataFrame, width_s: float, tau_s: float, rate_hz: float = SAMPLE_RATE_HZ) -> DataFrame:
    """(trial, fit_success, amplitude, t0_s, width_s, tau_s, background): one profile is one group of n_time rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t, y = part["t"].to_numpy() / rate_hz, part["power"].to_numpy(float)
        guess, background = float(part["peak_t"].iloc[0]) / rate_hz, float(part["baseline_mean"].iloc[0])
        top = max(float(y.max()), 1e-9)
        low = np.array([0.0, guess - FIT_REACH_S, FIT_WIDTH_S[0], 0.0, FIT_BACKGROUND])
        high = np.array([FIT_GAIN * top, guess + FIT_REACH_S, FIT_WIDTH_S[1], FIT_TAU_S, top])
        p, good = fit_pulse(t, y, np.array([top - background, guess, width_s, tau_s, background]), low, high)
        return pd.DataFrame([[int(part["trial"].iloc[0]), good, *p]], columns=["trial", "fit_success", "amplitude", "t0_s", "width_s", "tau_s", "background"])

    joined = profiles.join(F.broadcast(snrs), "trial").select("trial", "t", F.col("power").cast("double").alias("power"), "peak_t", "baseline_mean")
    return joined.groupBy("trial").applyInPandas(run, "trial int, fit_success boolean, amplitude double, t0_s double, width_s double, tau_s double, background double")


def recovery(fit: DataFrame, snr: DataFrame, burst: tuple, index: DataFrame | None = None) -> DataFrame:
    """Errors of a fit against the injected burst, and whether it passes (10 ms, 2 ms, 70 % of the target S/N).

    Scattering and spectral index (from spectral_index()) are reported, but do not decide.
    """
    _, _, arrival, width, tau, gamma, _, target = burst
    joined = fit.join(snr.select("trial", "snr"), "trial")
    if index is not None:
        joined = joined.crossJoin(F.broadcast(index.select("spectral_index")))  # one row
    err_t0, err_sigma = F.abs(F.col("t0_s") - arrival), F.abs(F.col("width_s") - width)
    passed = F.col("fit_success") & (err_t0 < MISS_ARRIVAL_S) & (err_sigma < MISS_WIDTH_S) & (F.col("snr") >= SNR_SHARE * target)
    errors = [(err_t0 * 1e3).alias("err_t0_ms"), (err_sigma * 1e3).alias("err_sigma_ms"), (F.abs(F.col("tau_s") - tau) * 1e3).alias("err_tau_ms")]
    if index is not None:
        errors.append(F.abs(F.col("spectral_index") - gamma).alias("err_gamma"))
    return joined.select("trial", *errors, "snr", passed.alias("passed"))


# --- validation of the whole chain


class Bench:
    """Bursts drawn into packed voltages, beamformed by the tracker and dedispersed: the four tests of a chain.

    Sampling, band and sizes are arguments. The waterfall of a run is stored, as every test reads it more than once.
    """

    def __init__(self, channels: DataFrame, n_time: int, store, n_ant: int = 64, rate_hz: float = SAMPLE_RATE_HZ, ref_hz: float = 800e6, engine: str = "frame"):
        self.channels, self.n_time, self.store, self.n_ant, self.rate_hz, self.ref_hz, self.engine = channels, n_time, store, n_ant, rate_hz, ref_hz, engine

    def waterfall(self, burst: tuple, n_ant: int | None = None, l: float = 0.0) -> DataFrame:  # noqa: E741
        """(t, f, power) of the beam at the zenith, with the burst at (l, 0)."""
        from beamquarry.model import Trajectory
        from beamquarry.operators import geometry, tracker

        spark = self.channels.sparkSession
        antennas = geometry.antennas(spark, n_ant or self.n_ant)
        positions = np.array([(r["x"], r["y"], r["z"]) for r in antennas.orderBy("a").collect()])
        light = self.store(synthesize(self.channels, burst, self.n_time, self.rate_hz, self.ref_hz), "burst-light")
        peak = light.agg(F.max("power")).first()[0]
        # the generators' sign, under which the tracker's weights add up in phase at the source
        frames = voltages(light, self.channels, positions, (l, 0.0), burst[7], peak, sign=-1, ref_ant=self.n_ant)
        return self.store(tracker.run_engine(self.engine, frames, Trajectory(), self.channels, antennas, self.n_time), "burst-waterfall")

    def snr(self, waterfall: DataFrame, dm: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(dedispersed, profile, S/N) at one dispersion measure."""
        trial = self.channels.sparkSession.range(1).select(F.lit(0).alias("trial"), F.lit(float(dm)).alias("dm"))
        moved = dedisperse(waterfall, shifts(self.channels, trial, self.rate_hz, self.ref_hz), self.n_time)
        profiles = profile(moved, self.n_time)
        return moved, profiles, profile_snr(profiles, self.n_time)

    def sweep_recovery(self, waterfall: DataFrame, burst: tuple, off_grid: float = 0.0, steps: int = SWEEP_STEPS, reach: float = SWEEP_RANGE) -> DataFrame:
        """(injected_dm, recovered_dm, dm_error, snr, passed). `off_grid` moves the trials by a share of their step, so that none is the true one."""
        step = 2 * reach * burst[1] / max(1, steps - 1)
        trials = trial_table(self.channels.sparkSession, burst[1], steps, reach).withColumn("dm", F.col("dm") + off_grid * step)
        best = best_trial(sweep(waterfall, self.channels, trials, self.n_time, self.rate_hz, self.ref_hz))
        error = F.abs(F.col("dm") - burst[1])
        return best.select(F.lit(burst[1]).alias("injected_dm"), F.col("dm").alias("recovered_dm"), error.alias("dm_error"), "snr", (error <= MISS_DM).alias("passed"))

    def refit(self, waterfall: DataFrame, burst: tuple) -> DataFrame:
        """recovery() of the pulse and the spectral index at the injected dispersion measure."""
        moved, profiles, snrs = self.snr(waterfall, burst[1])
        at = snrs.first()
        powers = channel_powers(moved, at["peak_t"], at["baseline_mean"], self.n_time, self.channels.count())
        return recovery(fit_profiles(profiles, snrs, burst[3], burst[4], self.rate_hz), snrs, burst, spectral_index(powers, self.channels, self.ref_hz))

    def off_boresight(self, burst: tuple, offsets: tuple = OFFSETS) -> DataFrame:
        """(l, snr, passed): S/N as the source leaves the beam; it must not rise over the first four offsets."""
        from beamquarry.operators.compare import falls_monotonically

        found = [(float(l), self.snr(self.waterfall(burst, l=l), burst[1])[2].first()["snr"]) for l in offsets]  # noqa: E741
        points = self.channels.sparkSession.createDataFrame(found, "l double, snr double")
        return points.crossJoin(F.broadcast(falls_monotonically(points, "l", "snr").withColumnRenamed("monotonic", "passed")))

    def array_scaling(self, burst: tuple, antennas: tuple = SCALING_ANTENNAS) -> DataFrame:
        """(slope, passed): log of voltage S/N over log of antennas, one half by theory."""
        from beamquarry.operators.compare import log_slope

        found = [(n, max(0.0, self.snr(self.waterfall(burst, n_ant=n), burst[1])[2].first()["snr"]) ** 0.5) for n in antennas]
        slope = log_slope(self.channels.sparkSession.createDataFrame(found, "n int, snr double"), "n", "snr")
        return slope.withColumn("passed", F.col("slope").between(*SLOPES))
