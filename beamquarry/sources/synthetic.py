"""Deterministic sample generators: every value follows from its place and a seed, not from how rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import FIRST_HZ, LOCAL_CHANNELS, STEP_HZ, Dimensions, ShardDescriptor, Trajectory
from beamquarry.operators import geometry, tracker

#: Fixed value: what the second shard's noise seed differs by.
SHARD_SEED = 0x9E3779B9


def cube(spark: SparkSession, dims: Dimensions) -> DataFrame:
    """(t, f, a) of all samples."""
    k = F.col("id")
    t = F.floor(k / (dims.n_freq * dims.n_ant)).cast("long").alias("t")
    return spark.range(dims.samples).select(t, F.pmod(F.floor(k / dims.n_ant), F.lit(dims.n_freq)).cast("int").alias("f"), F.pmod(k, F.lit(dims.n_ant)).cast("int").alias("a"))


def one_hot(spark: SparkSession, dims: Dimensions, t: int, f: int, a: int, re: int, im: int) -> DataFrame:
    """(t, f, a, byte): zero but for one sample."""
    if not (0 <= t < dims.n_time and 0 <= f < dims.n_freq and 0 <= a < dims.n_ant):
        raise IndexError("the active sample is outside the cube")
    here = (F.col("t") == t) & (F.col("f") == f) & (F.col("a") == a)
    return cube(spark, dims).withColumn("byte", F.when(here, S.pack(F.lit(re), F.lit(im))).otherwise(0))


def constant(spark: SparkSession, dims: Dimensions, re: int, im: int) -> DataFrame:
    return cube(spark, dims).withColumn("byte", S.pack(F.lit(re), F.lit(im)))


def _wave(amplitude: float, angle: Column) -> Column:
    """A exp(-i phase), rounded half away from zero."""
    return S.pack(F.round(amplitude * F.cos(angle)).cast("int"), F.round(-amplitude * F.sin(angle)).cast("int"))


def _check_amplitude(amplitude: float) -> None:
    if not math.isfinite(amplitude) or not 0 < amplitude <= 7:
        raise ValueError("amplitude must be in (0, 7]")


def point_source(spark: SparkSession, n_time: int, channels: DataFrame, antennas: DataFrame, l: float, m: float, amplitude: float) -> DataFrame:  # noqa: E741
    """(t, f, a, byte): a still source; its one spectrum is computed once and repeated over time."""
    _check_amplitude(amplitude)
    n = math.sqrt(1 - l * l - m * m)
    angle = S.phase(F.col("hz"), F.col("x"), F.col("y"), F.col("z"), F.lit(l), F.lit(m), F.lit(n))
    spectrum = channels.crossJoin(F.broadcast(antennas)).select("f", "a", _wave(amplitude, angle).alias("byte"))
    return spark.range(n_time).select(F.col("id").alias("t")).crossJoin(F.broadcast(spectrum))  # one spectrum is bounded by the dimensions


def moving_source(spark: SparkSession, n_time: int, channels: DataFrame, antennas: DataFrame, path: Trajectory, amplitude: float) -> DataFrame:
    """(t, f, a, byte): a source whose direction moves with each sample."""
    _check_amplitude(amplitude)
    steered = tracker.steer(spark.range(n_time).select(F.col("id").alias("w")), path.check(n_time, 1), 1).withColumnRenamed("w", "t")
    angle = S.phase(*(F.col(c) for c in ("hz", "x", "y", "z", "l", "m", "n")))
    return steered.crossJoin(F.broadcast(channels.crossJoin(F.broadcast(antennas)))).select("t", "f", "a", _wave(amplitude, angle).alias("byte"))


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def noise(spark: SparkSession, dims: Dimensions, seed: int) -> DataFrame:
    """(t, f, a, byte): both components uniform over -7 to 7."""
    re, im = (F.pmod(_hash(seed * 2 + k, "t", "f", "a"), F.lit(15)).cast("int") - 7 for k in (0, 1))
    return cube(spark, dims).withColumn("byte", S.pack(re, im))


def loss_mask(spark: SparkSession, dims: Dimensions, seed: int, probability: float) -> DataFrame:
    """(t, f, valid): lost with a probability."""
    if not 0 <= probability <= 1:
        raise ValueError("loss probability must be in [0, 1]")
    k = F.col("id")
    rows = spark.range(dims.n_time * dims.n_freq).select(F.floor(k / dims.n_freq).cast("long").alias("t"), F.pmod(k, F.lit(dims.n_freq)).cast("int").alias("f"))
    draw = F.pmod(_hash(seed, "t", "f"), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("valid", draw >= probability)


def two_shards(parts: list[DataFrame]) -> DataFrame:
    """One table of two shards' rows, each with its shard_id."""
    if len(parts) != 2:
        raise ValueError("there are two shards")
    first, second = (p.withColumn("shard_id", F.lit(k)) for k, p in enumerate(parts))
    return first.unionByName(second)


def two_shard_noise(spark: SparkSession, dims: Dimensions, seed: int) -> DataFrame:
    return two_shards([noise(spark, dims, seed + SHARD_SEED * k) for k in (0, 1)])


def two_shard_one_hot(spark: SparkSession, dims: Dimensions, t: int, channels: tuple[int, int], elements: tuple[int, int], re: int, im: int) -> DataFrame:
    return two_shards([one_hot(spark, dims, t, f, a, re, im) for f, a in zip(channels, elements, strict=True)])


def two_shard_constant(spark: SparkSession, dims: Dimensions, re: int, im: int) -> DataFrame:
    return two_shards([constant(spark, dims, re, im)] * 2)


def two_shard_point_source(spark: SparkSession, dims: Dimensions, l: float, m: float, amplitude: float) -> DataFrame:  # noqa: E741
    """Each shard at its own part of the band."""
    antennas = geometry.antennas(spark, dims.n_ant)
    starts = [FIRST_HZ + k * LOCAL_CHANNELS * STEP_HZ for k in (0, 1)]
    return two_shards([point_source(spark, dims.n_time, geometry.channels(spark, dims.n_freq, s), antennas, l, m, amplitude) for s in starts])


def two_shard_masks(spark: SparkSession, dims: Dimensions, seeds: tuple[int, int], probability: float) -> DataFrame:
    return two_shards([loss_mask(spark, dims, s, probability) for s in seeds])


def shard_table(spark: SparkSession, shards: list[ShardDescriptor] | None = None) -> DataFrame:
    shards = shards or [ShardDescriptor.default(k) for k in (0, 1)]
    schema = "shard_id int, shard_count int, local_frequency_count int, absolute_frequency_start int, timestamp_start long, timestamp_step long, loss_mask_id long, loss_mask_independent boolean"
    return spark.createDataFrame([tuple(vars(s.check()).values()) for s in shards], schema)


def tiled_noise(spark: SparkSession, dims: Dimensions, seed: int) -> DataFrame:
    """One spectrum of noise repeated over time: the throughput workload."""
    one = noise(spark, Dimensions(1, dims.n_freq, dims.n_ant, dims.n_beams), seed).drop("t")
    return spark.range(dims.n_time).select(F.col("id").alias("t")).crossJoin(F.broadcast(one))


def write_fake_data(spark: SparkSession, path: str, kind: str, dims: Dimensions, seed: int = 1, loss: float = 0.0) -> None:
    """Payload, mask and descriptors of two shards under a folder, by shard."""
    makers = {
        "noise": lambda: two_shard_noise(spark, dims, seed),
        "constant": lambda: two_shard_constant(spark, dims, 1, 0),
        "one_hot": lambda: two_shard_one_hot(spark, dims, 0, (0, 0), (0, 0), 1, 0),
        "point_source": lambda: two_shard_point_source(spark, dims, 0.1, 0.0, 5.0),
        "zero": lambda: two_shard_constant(spark, dims, 0, 0),
    }
    if kind not in makers:
        raise ValueError(f"kind is one of {', '.join(makers)}")
    makers[kind]().write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/payload")
    two_shard_masks(spark, dims, (seed, seed + 1), loss).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/mask")
    shard_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")
