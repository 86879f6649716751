"""int8 quantization of integrated power in tiles of 1 window x 16 channels x 16 beams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import INVALID_CODE, MAX_CODE, MIN_CODE, TILE

TILE_KEYS = ("w", "ft", "bt")


def with_tile(values: DataFrame) -> DataFrame:
    return values.withColumn("ft", F.floor(F.col("f") / TILE[1]).cast("int")).withColumn("bt", F.floor(F.col("b") / TILE[2]).cast("int"))


def _parameters(low, high, all_finite):
    """Offset and scale of a tile; both 0 where a value is not finite."""
    scale = (high - low) / 255.0
    offset = low + 127.5 * scale
    flat = high == low
    return (
        F.when(~all_finite, 0.0).when(flat, low).otherwise(offset).alias("offset"),
        F.when(~all_finite | flat, 0.0).otherwise(scale).alias("scale"),
    )


def tile_parameters(values: DataFrame, value: str = "power") -> DataFrame:
    """(w, ft, bt, offset, scale) by a grouped minimum and maximum."""
    v, good = F.col(value), S.finite(F.col(value))
    sums = with_tile(values).groupBy(*TILE_KEYS).agg(F.min(F.when(good, v)).alias("_low"), F.max(F.when(good, v)).alias("_high"), F.bool_and(good).alias("_ok"))
    return sums.select(*TILE_KEYS, *_parameters(F.col("_low"), F.col("_high"), F.col("_ok")))


def quantize(values: DataFrame, value: str = "power") -> DataFrame:
    """(w, f, b, value, offset, scale, code): the tile's range is put beside each value in one shuffle by tile."""
    tile = Window.partitionBy(*TILE_KEYS)
    v, good = F.col(value), S.finite(F.col(value))
    ranged = (
        with_tile(values)
        .withColumn("_low", F.min(F.when(good, v)).over(tile))
        .withColumn("_high", F.max(F.when(good, v)).over(tile))
        .withColumn("_ok", F.min(good.cast("int")).over(tile) == 1)
    )
    ranged = ranged.select("w", "f", "b", value, *_parameters(F.col("_low"), F.col("_high"), F.col("_ok")))
    return ranged.withColumn("code", S.quantize(v, F.col("offset"), F.col("scale")))


def dequantize(codes: DataFrame, parameters: DataFrame) -> DataFrame:
    """(w, f, b, value): codes joined with their tile's parameters."""
    joined = with_tile(codes.select("w", "f", "b", "code")).join(parameters, list(TILE_KEYS))
    return joined.select("w", "f", "b", S.dequantize(F.col("code"), F.col("offset"), F.col("scale")).alias("value"))


def stats(quantized: DataFrame, value: str = "power") -> DataFrame:
    """One row: counts, largest and mean absolute error, normalized error and codes at the ends."""
    v = F.col(value)
    good = S.finite(v) & (F.col("code") != INVALID_CODE)
    error = F.when(good, F.abs(S.dequantize(F.col("code"), F.col("offset"), F.col("scale")) - v))
    sums = quantized.agg(
        F.count_if(good).alias("finite_samples"),
        F.count_if(~good).alias("invalid_samples"),
        F.coalesce(F.max(error), F.lit(0.0)).alias("max_abs_error"),
        F.coalesce(F.avg(error), F.lit(0.0)).alias("mean_abs_error"),
        F.sum(error * error).alias("_e2"),
        F.sum(F.when(good, v * v)).alias("_r2"),
        F.count_if(good & (F.col("code") == MIN_CODE)).alias("min_code_samples"),
        F.count_if(good & (F.col("code") == MAX_CODE)).alias("max_code_samples"),
    )
    over = F.when(F.col("_r2") > 0, F.col("_r2")).otherwise(F.col("finite_samples").cast("double"))
    return sums.withColumn("nrmse", F.coalesce(F.sqrt(F.try_divide(F.col("_e2"), over)), F.lit(0.0))).drop("_e2", "_r2")


def layout(n_time: int, n_freq: int, n_beams: int) -> tuple[int, int, int]:
    """Tiles along windows, channels and beams."""
    return tuple(-(-n // size) for n, size in zip((n_time, n_freq, n_beams), TILE, strict=True))
