"""Raw tensors, text tables and metadata: readers with the checks that a file must pass, and writers."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import BEAM_TILE, INVALID_CODE, LOCAL_CHANNELS, TILE, Dimensions
from beamquarry.sources import rawfile
from beamquarry.sources.rawfile import Layout

QUANTIZED_FORMAT, SHARD_FORMAT, PARAMETERS_FORMAT = "quantized-int8-v1", "packed-shard-v1", "little-endian-float32[offset,scale]"


def read_packed_voltage(spark: SparkSession, path: str, dims: Dimensions, shard_id: int = 0, **how: int) -> DataFrame:
    """(shard_id, t, f, payload): a tensor of [t][f][element] bytes by frames."""
    frames = rawfile.read(spark, path, _frames(dims), **how)
    return frames.select(F.lit(shard_id).alias("shard_id"), "t", "f", "payload")


def read_packed_spectra(spark: SparkSession, path: str, dims: Dimensions, **how: int) -> DataFrame:
    """(t, payload): one row for each spectrum of a tensor of [t][f][element] bytes, for the tracker over whole spectra."""
    return rawfile.read(spark, path, Layout((("t", "long", dims.n_time),), ("payload",), "bytes", dims.n_freq * dims.n_ant), **how)


def _frames(dims: Dimensions) -> Layout:
    return Layout((("t", "long", dims.n_time), ("f", "int", dims.n_freq)), ("payload",), "bytes", dims.n_ant)


def _values(kind: str, shape: tuple[int, ...], names: list[str], values: list[str]) -> Layout:
    return Layout(tuple((n, "long", k) for n, k in zip(names, shape, strict=True)), tuple(values), kind)


def _weights(dims: Dimensions) -> Layout:
    return _values("f4", (dims.n_beams, dims.n_freq, dims.n_ant), ["b", "f", "a"], ["wr", "wi"])


def _tiled(dims: Dimensions, tile: int) -> Layout:
    return _values("f4", (dims.n_freq, -(-dims.n_beams // tile), dims.n_ant, tile), ["f", "tile", "a", "lane"], ["wr", "wi"])


def _intensity(dims: Dimensions) -> Layout:
    return _values("f4", (dims.n_time, dims.n_freq, dims.n_beams), ["t", "f", "b"], ["power"])


def _quantized(dims: Dimensions) -> Layout:
    return _values("i1", (dims.n_time, dims.n_freq, dims.n_beams), ["w", "f", "b"], ["code"])


def _parameters(dims: Dimensions) -> Layout:
    shape = tuple(-(-n // s) for n, s in zip((dims.n_time, dims.n_freq, dims.n_beams), TILE, strict=True))
    return _values("f4", shape, ["w", "ft", "bt"], ["offset", "scale"])


def read_weights(spark: SparkSession, path: str, dims: Dimensions) -> DataFrame:
    return rawfile.read(spark, path, _weights(dims))


def read_tiled_weights(spark: SparkSession, path: str, dims: Dimensions, tile: int = BEAM_TILE) -> DataFrame:
    return rawfile.read(spark, path, _tiled(dims, tile))


def read_intensity(spark: SparkSession, path: str, dims: Dimensions, **how: int) -> DataFrame:
    return rawfile.read(spark, path, _intensity(dims), **how)


def read_quantized(spark: SparkSession, path: str, dims: Dimensions, **how: int) -> DataFrame:
    return rawfile.read(spark, path, _quantized(dims), **how)


def read_quantization_parameters(spark: SparkSession, path: str, dims: Dimensions) -> DataFrame:
    return rawfile.read(spark, path, _parameters(dims))


def write_packed_voltage(frames: DataFrame, path: str, dims: Dimensions, **how: int) -> None:
    rawfile.write(frames, path, _frames(dims), **how)


def write_weights(weights: DataFrame, path: str, dims: Dimensions) -> None:
    rawfile.write(weights, path, _weights(dims))


def write_tiled_weights(weights: DataFrame, path: str, dims: Dimensions, tile: int = BEAM_TILE) -> None:
    rawfile.write(weights, path, _tiled(dims, tile))


def write_intensity(power: DataFrame, path: str, dims: Dimensions, **how: int) -> None:
    rawfile.write(power, path, _intensity(dims), **how)


def write_quantized(codes: DataFrame, path: str, dims: Dimensions, **how: int) -> None:
    rawfile.write(codes, path, _quantized(dims), **how)


def write_quantization_parameters(tiles: DataFrame, path: str, dims: Dimensions) -> None:
    rawfile.write(tiles, path, _parameters(dims))


def read_two_shards(spark: SparkSession, paths: list[str], dims: Dimensions) -> DataFrame:
    """Intensity of two buffers side by side: the second's channels follow the first's."""
    parts = [read_intensity(spark, p, dims).withColumn("f", F.col("f") + k * dims.n_freq) for k, p in enumerate(paths)]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


# --- text tables


def _text_rows(spark: SparkSession, path: str, fields: int, count: int | None) -> DataFrame:
    """(at, v): numbered rows of numbers; comments after #, commas or blanks between, all fields there, the count right.

    Such files describe one array and have a few hundred lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("raw", "#.*", ""), "[,\\s]+", " "))
    rows = lines.withColumn("text", clean).where("text <> ''").withColumn("parts", F.split("text", " "))
    bad = F.concat(F.lit(f"{path}:"), (F.col("line") + 1).cast("string"), F.lit(f": expected {fields} numbers"))
    numbers = F.transform("parts", lambda x: x.try_cast("double"))
    good = (F.size("parts") == fields) & ~F.exists(numbers, lambda x: x.isNull())
    values = rows.withColumn("v", F.when(good, numbers).otherwise(F.raise_error(bad).cast("array<double>"))).select("line", "v")
    whole = values.agg(F.array_sort(F.collect_list(F.struct("line", "v"))).alias("rows"))
    if count is not None:
        wrong = F.concat(F.lit(f"{path}: expected {count} rows, found "), F.size("rows").cast("string"))
        whole = whole.withColumn("rows", F.when(F.size("rows") == count, F.col("rows")).otherwise(F.raise_error(wrong).cast(whole.schema["rows"].dataType)))
    return whole.select(F.posexplode("rows").alias("at", "row")).select("at", F.col("row.v").alias("v"))


def load_positions(spark: SparkSession, path: str, n_ant: int | None = None) -> DataFrame:
    return _text_rows(spark, path, 3, n_ant).select(F.col("at").alias("a"), *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])


def load_frequencies(spark: SparkSession, path: str, n_freq: int | None = None) -> DataFrame:
    hz = F.when(F.col("v")[0] > 0, F.col("v")[0]).otherwise(F.raise_error(F.lit(f"{path}: frequencies must be positive")).cast("double"))
    return _text_rows(spark, path, 1, n_freq).select(F.col("at").alias("f"), hz.alias("hz"))


def load_directions(spark: SparkSession, path: str, n_beams: int | None = None) -> DataFrame:
    rows = _text_rows(spark, path, 3, n_beams).select(F.col("at").alias("b"), *[F.col("v")[i].alias(c) for i, c in enumerate("lmn")])
    norm = F.sqrt(F.col("l") ** 2 + F.col("m") ** 2 + F.col("n") ** 2)
    return rows.withColumn("n", F.when(F.abs(norm - 1) <= 1e-3, F.col("n")).otherwise(F.raise_error(F.lit(f"{path}: directions must be unit vectors")).cast("double")))


# --- metadata of key=value lines


def read_metadata(spark: SparkSession, path: str, required: list[str]) -> dict[str, str]:
    """Some two dozen fields of one file; a line without = or a missing field is an error."""
    lines = [r["value"] for r in spark.read.text(path).collect()]
    if any(x.find("=") < 1 for x in lines):
        raise ValueError(f"invalid metadata line in {path}")
    found = dict(x.split("=", 1) for x in lines)
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"missing metadata fields in {path}: {', '.join(missing)}")
    return found


DIMENSION_FIELDS = ["n_time", "n_freq", "n_ant", "n_beams"]
SHARD_FIELDS = ["shard_id", "shard_count", "local_frequency_count", "absolute_frequency_start", "timestamp_start", "timestamp_step", "loss_mask_id", "loss_mask_independent"]


def quantized_metadata(dims: Dimensions, input_n_time: int, spectra: int, parameters_file: str, shard: dict) -> dict[str, object]:
    """The fields that describe a quantized output; tiles, codes and counts follow from the dimensions."""
    if spectra <= 0 or -(-input_n_time // spectra) != dims.n_time or not parameters_file:
        raise ValueError("output windows must match the input and its integration")
    tiles = int(np.prod([-(-n // s) for n, s in zip((dims.n_time, dims.n_freq, dims.n_beams), TILE, strict=True)]))
    chunk = dict(zip(("chunk_time", "chunk_frequency", "chunk_beam"), TILE, strict=True))
    return {
        "format": QUANTIZED_FORMAT, **{k: getattr(dims, k) for k in DIMENSION_FIELDS}, "input_n_time": input_n_time, "integration_spectra": spectra, **chunk,
        "invalid_code": INVALID_CODE, "parameters_format": PARAMETERS_FORMAT, "parameters_file": parameters_file, "parameters_count": tiles, **{k: int(shard[k]) for k in SHARD_FIELDS},
    }


def write_metadata(spark: SparkSession, path: str, fields: dict[str, object]) -> None:
    spark.createDataFrame([(f"{k}={v}",) for k, v in fields.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_quantized_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    found = read_metadata(spark, path, ["format", *DIMENSION_FIELDS, "input_n_time", "integration_spectra", "parameters_file", "parameters_count", *SHARD_FIELDS])
    dims = Dimensions(*(int(found[k]) for k in DIMENSION_FIELDS))
    want = quantized_metadata(dims, int(found["input_n_time"]), int(found["integration_spectra"]), found["parameters_file"], {k: found[k] for k in SHARD_FIELDS})
    if bad := [k for k, v in want.items() if found.get(k) != str(v)]:
        raise ValueError(f"unsupported or inconsistent metadata in {path}: {', '.join(bad)}")
    return found


def write_packed_shards(payload: DataFrame, mask: DataFrame, shards: DataFrame, path: str) -> None:
    """Payload and mask by shard, with the shards' descriptors."""
    payload.write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/payload")
    mask.write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/mask")
    shards.coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")


def read_packed_shards(spark: SparkSession, path: str, shard_id: int | None = None, dims: Dimensions | None = None) -> DataFrame:
    """Frames with their shard's descriptor and their validity; reading one shard prunes the other's files.

    With dimensions given, sizes, masks and descriptors are checked before any row is returned.
    """
    payload, mask, shards = (spark.read.parquet(f"{path}/{x}") for x in ("payload", "mask", "shards"))
    if dims is not None and (faults := shard_faults(payload, mask, shards, dims).collect()):  # six kinds at most
        raise ValueError(f"{path}: {', '.join(sorted(r['fault'] for r in faults))}")
    if shard_id is not None:
        payload, mask = payload.where(F.col("shard_id") == shard_id), mask.where(F.col("shard_id") == shard_id)
    return payload.join(mask, ["shard_id", "t", "f"]).join(F.broadcast(shards), "shard_id")  # two rows


def shard_faults(payload: DataFrame, mask: DataFrame, shards: DataFrame, dims: Dimensions) -> DataFrame:
    """(fault, n): what breaks the rules of a shard set, and in how many shards or descriptors; no rows if nothing does.

    A shard without any payload or mask has the wrong size too.
    """
    frames = dims.n_time * dims.n_freq
    names = shards.select("shard_id")
    held = payload.groupBy("shard_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.octet_length("payload") != dims.n_ant).alias("_bad"))
    masked = mask.groupBy("shard_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("valid").isNull()).alias("_bad"))
    held, masked = (names.join(x, "shard_id", "left").fillna(0, ["_n", "_bad"]) for x in (held, masked))
    descriptor = (
        ~F.col("loss_mask_independent") | (F.col("timestamp_step") <= 0) | (F.col("shard_id") >= F.col("shard_count")) | (F.col("shard_count") != 2)
        | (F.col("absolute_frequency_start") < 0) | (F.col("absolute_frequency_start") > LOCAL_CHANNELS) | (F.col("local_frequency_count") != dims.n_freq)
    )
    faults = {
        "payload size": held.where((F.col("_n") != frames) | (F.col("_bad") > 0)),
        "mask size": masked.where(F.col("_n") != frames),
        "mask value": masked.where(F.col("_bad") > 0),
        "frequency origin": shards.groupBy("absolute_frequency_start").count().where("count > 1"),
        "mask id": shards.groupBy("loss_mask_id").count().where("count > 1"),
        "descriptor": shards.where(descriptor),
    }
    named = [rows.select(F.lit(fault).alias("fault")) for fault, rows in faults.items()]
    return reduce(DataFrame.unionByName, named).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def decoded(frames: DataFrame, n_ant: int) -> DataFrame:
    """(t, f, a, re, im) from packed frames, on the JVM: for oracles and small data, as it makes a row for each sample."""
    hexed = F.hex("payload")
    byte: Column = F.conv(F.substring(hexed, 2 * F.col("a") + 1, F.lit(2)), 16, 10).cast("int")
    rows = frames.select("t", "f", "payload", F.explode(F.sequence(F.lit(0), F.lit(n_ant - 1))).alias("a"))
    return rows.withColumn("_b", byte).select("t", "f", "a", S.unpack_re(F.col("_b")).alias("re"), S.unpack_im(F.col("_b")).alias("im"))
