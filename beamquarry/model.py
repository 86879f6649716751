"""Dimensions, shard descriptors, tracker settings and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

#: Channels of one shard, antennas of one digitizer block, allowed array sizes, most beams.
LOCAL_CHANNELS, BLOCK_ANTENNAS, ANTENNA_COUNTS, MAX_BEAMS = 336, 32, (32, 64, 128, 256), 128
#: First channel and channel step in Hz, antenna pitch in m, speed of light in m/s.
FIRST_HZ, STEP_HZ, PITCH_M, LIGHT_M_S = 300e6, 0.3e6, 0.6, 299792458.0
#: Spectra summed after the upchannelizer, and directly; beams of a weight tile.
POST_CHANNELIZER_SPECTRA, DIRECT_SPECTRA, BEAM_TILE = 10, 320, 32
#: Fixed value: how far a start direction's square may be from 1.
UNIT_SLACK = 1e-3
#: Quantizer tile (windows, channels, beams) and codes.
TILE, INVALID_CODE, MIN_CODE, MAX_CODE = (1, 16, 16), -128, -127, 127


@dataclass(frozen=True)
class Dimensions:
    n_time: int = 15360
    n_freq: int = LOCAL_CHANNELS
    n_ant: int = 64
    n_beams: int = 64

    def check(self, channels: int | None = LOCAL_CHANNELS) -> Dimensions:
        """Raise ValueError unless valid; `channels` is the required channel count (None: any)."""
        if self.n_time <= 0:
            raise ValueError("n_time must be positive")
        if self.n_freq <= 0 or (channels is not None and self.n_freq != channels):
            raise ValueError(f"n_freq must be {channels}")
        if self.n_ant not in ANTENNA_COUNTS:
            raise ValueError(f"n_ant must be one of {ANTENNA_COUNTS}")
        if not 1 <= self.n_beams <= MAX_BEAMS:
            raise ValueError(f"n_beams must be between 1 and {MAX_BEAMS}")
        return self

    @property
    def samples(self) -> int:
        return self.n_time * self.n_freq * self.n_ant

    @property
    def voltage_bytes(self) -> int:
        return self.samples

    @property
    def weight_values(self) -> int:
        return self.n_beams * self.n_freq * self.n_ant

    @property
    def tiled_weight_values(self) -> int:
        return self.n_freq * -(-self.n_beams // BEAM_TILE) * BEAM_TILE * self.n_ant

    @property
    def intensity_values(self) -> int:
        return self.n_time * self.n_freq * self.n_beams

    @property
    def mask_bytes(self) -> int:
        return self.n_time * self.n_freq

    def integrated(self, spectra: int) -> Dimensions:
        return replace(self, n_time=integrated_count(self.n_time, spectra))


def integrated_count(n_time: int, spectra: int) -> int:
    """Windows of a non-empty stream; the last may be partial."""
    if n_time <= 0 or spectra <= 0:
        raise ValueError("time and integration counts must be positive")
    return -(-n_time // spectra)


def window_count(n_time: int, spectra: int) -> int:
    """Windows that a tracker steers; none for an empty stream."""
    if spectra <= 0:
        raise ValueError("integration count must be positive")
    return -(-n_time // spectra)


@dataclass(frozen=True)
class ShardDescriptor:
    shard_id: int
    shard_count: int = 2
    local_frequency_count: int = LOCAL_CHANNELS
    absolute_frequency_start: int = 0
    timestamp_start: int = 0
    timestamp_step: int = 1
    loss_mask_id: int = 0
    loss_mask_independent: bool = True

    @classmethod
    def default(cls, shard_id: int) -> ShardDescriptor:
        return cls(shard_id, absolute_frequency_start=shard_id * LOCAL_CHANNELS, loss_mask_id=shard_id)

    def check(self) -> ShardDescriptor:
        if self.shard_count != 2 or not 0 <= self.shard_id < self.shard_count:
            raise ValueError("there are two shards, 0 and 1")
        if self.local_frequency_count != LOCAL_CHANNELS:
            raise ValueError(f"a shard has {LOCAL_CHANNELS} channels")
        if not 0 <= self.absolute_frequency_start <= (self.shard_count - 1) * LOCAL_CHANNELS:
            raise ValueError("a shard lies inside the full band")
        if self.timestamp_step <= 0:
            raise ValueError("timestamp_step must be positive")
        if not self.loss_mask_independent:
            raise ValueError("shards have independent loss masks")
        return self


@dataclass(frozen=True)
class Trajectory:
    """Direction cosines that move by a constant rate with each sample."""

    l0: float = 0.0
    m0: float = 0.0
    l_rate: float = 0.0
    m_rate: float = 0.0

    def at(self, t: float) -> tuple[float, float, float]:
        l, m = self.l0 + t * self.l_rate, self.m0 + t * self.m_rate  # noqa: E741
        inside = 1.0 - l * l - m * m
        if not math.isfinite(inside) or inside < 0:
            raise ValueError(f"direction ({l}, {m}) at sample {t} is outside the unit disk")
        return l, m, math.sqrt(inside)

    @classmethod
    def from_direction(cls, start: tuple[float, float, float], rate: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Trajectory:
        """From a start (l, m, n), a unit vector to 1e-3, and a finite rate; n follows from l and m."""
        square = sum(x * x for x in start)
        if not math.isfinite(square) or abs(square - 1) > UNIT_SLACK:
            raise ValueError("the start direction must be a finite unit vector")
        if not all(map(math.isfinite, rate)):
            raise ValueError("the rate must be finite")
        return cls(start[0], start[1], rate[0], rate[1])

    def check(self, n_time: int, spectra: int) -> Trajectory:
        """The path is a straight line, so its ends decide whether all windows stay in the disk."""
        if spectra <= 0:
            raise ValueError("integration count must be positive")
        if not all(map(math.isfinite, (self.l_rate, self.m_rate))):
            raise ValueError("the rate must be finite")
        last = (max(1, window_count(n_time, spectra)) - 1) * spectra
        self.at(0)
        self.at(last)
        return self


def check_tracker(dims: Dimensions, path: Trajectory, spectra: int, channels: int | None = LOCAL_CHANNELS) -> None:
    """What a tracker's run must meet before any work: valid dimensions, one beam, a window, and a path in the disk to its end."""
    dims.check(channels)
    if dims.n_beams != 1:
        raise ValueError("a tracker has one beam")
    path.check(dims.n_time, spectra)


@dataclass(frozen=True)
class SearchConfig:
    """Direction-of-arrival search: grid, refinement, estimator and covariance memory."""

    spectra: int = DIRECT_SPECTRA
    grid: int = 16
    levels: int = 2
    fov_l: float = 0.2
    fov_m: float = 0.2
    estimator: str = "bartlett"
    diagonal_load: float = 1e-2
    forgetting: float = 1.0
    subarray: int = 0
    interpolate: bool = False
    #: "reference" moves only where the response is convex, "corrected" where it is concave.
    interpolation: str = "reference"
    prior: Trajectory = field(default_factory=Trajectory)

    def check(self, n_ant: int) -> SearchConfig:
        if self.spectra <= 0 or self.grid < 0 or self.levels < 0:
            raise ValueError("search sizes must not be negative")
        if self.estimator not in ("bartlett", "capon"):
            raise ValueError("estimator is bartlett or capon")
        if self.interpolation not in ("reference", "corrected"):
            raise ValueError("interpolation is reference or corrected")
        if not 0 < self.forgetting <= 1:
            raise ValueError("forgetting must be in (0, 1]")
        if self.diagonal_load < 0 or self.fov_l <= 0 or self.fov_m <= 0:
            raise ValueError("diagonal load and field of view must be positive")
        if self.subarray and not 2 <= self.subarray <= n_ant:
            raise ValueError("a sub-array has between 2 and n_ant elements")
        return self


def resolve_channels(buffer: str | None = None, n_freq: int | None = None) -> tuple[str, int, int]:
    """(buffer, channels, first absolute channel) of buffer 0, 1 or both; without one, the channel count tells (336: buffer 0, 672: both)."""
    counts = {"0": LOCAL_CHANNELS, "1": LOCAL_CHANNELS, "both": 2 * LOCAL_CHANNELS}
    if buffer is None:
        by_count = {None: "0", LOCAL_CHANNELS: "0", 2 * LOCAL_CHANNELS: "both"}
        if n_freq not in by_count:
            raise ValueError(f"n_freq is {LOCAL_CHANNELS} or {2 * LOCAL_CHANNELS}")
        buffer = by_count[n_freq]
    if buffer not in counts:
        raise ValueError(f"buffer is one of {', '.join(counts)}")
    if n_freq not in (None, counts[buffer]):
        raise ValueError(f"buffer {buffer} has {counts[buffer]} channels, not {n_freq}")
    return buffer, counts[buffer], LOCAL_CHANNELS if buffer == "1" else 0


def buffer_label(buffer: str) -> str:
    name, channels, first = resolve_channels(buffer)
    return f"buffer {name}: channels {first} to {first + channels - 1}"
