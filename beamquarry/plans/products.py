"""More registered queries: files written and read back, generators, scalar functions, grids, records and logs, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import Dimensions, SearchConfig, Trajectory, buffer_label, integrated_count, resolve_channels, window_count
from beamquarry.operators import asof, beamform, burst, compare, doa, geometry, quantize, tracker
from beamquarry.operators.percentiles import percentiles
from beamquarry.plans import views as V
from beamquarry.plans.catalog import FRAME_SPECTRA, STILL, TRACK_SQL, is_folder, positions, query, searched
from beamquarry.session import kept, scratch_path
from beamquarry.sources import records, synthetic, tensors
from beamquarry.streaming import windows

#: A dense cube of 12 spectra, 4 channels, 32 antennas and 5 beams: the line items laid over each other.
DENSE = Dimensions(12, 4, 32, 5)


def dense(spark, sf_dir):
    """(t, f, a, byte) for every place of the cube."""
    sums = V.voltage(spark, sf_dir).groupBy((F.col("t") % 12).alias("t"), (F.col("f") % 4).alias("f"), "a").agg((F.sum("byte") % 256).cast("int").alias("byte"))
    return synthetic.cube(spark, DENSE).join(sums, ["t", "f", "a"], "left").select("t", "f", "a", F.coalesce("byte", F.lit(0)).alias("byte"))


def dense_power(spark, sf_dir):
    rows = dense(spark, sf_dir).select("t", "f", "a", "byte", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b"))
    return rows.groupBy("t", "f", "b").agg((F.sum(F.col("byte") * (F.col("a") * 7 + F.col("b"))) % 65536).cast("double").alias("power"))


def payloads(spark, sf_dir):
    """(t, f, payload) of the dense cube."""
    rows = dense(spark, sf_dir).groupBy("t", "f").agg(F.array_sort(F.collect_list(F.struct("a", "byte"))).alias("s"))
    return rows.select("t", "f", F.unhex(F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")).alias("payload"))


V.SQL |= {
    "dense": """SELECT t.range AS t, f.range AS f, a.range AS a, coalesce(byte, 0) AS byte FROM range(12) t CROSS JOIN range(4) f CROSS JOIN range(32) a LEFT JOIN
        (SELECT t % 12 AS t, f % 4 AS f, a, sum(byte) % 256 AS byte FROM voltage GROUP BY 1, 2, 3) v ON v.t = t.range AND v.f = f.range AND v.a = a.range""",
    "dense_power": "SELECT t, f, b.range AS b, sum(byte * (a * 7 + b.range)) % 65536 AS power FROM dense, range(5) b GROUP BY 1, 2, 3",
    "dense_range": "SELECT t AS w, f // 16 AS ft, b // 16 AS bt, min(power) AS low, max(power) AS high FROM dense_power GROUP BY 1, 2, 3",
    "dense_tiles": """SELECT w, ft, bt, CASE WHEN low = high THEN low ELSE low + 127.5::DOUBLE * ((high - low) / 255.0::DOUBLE) END AS "offset",
        (high - low) / 255.0::DOUBLE AS scale FROM dense_range""",
}


# --- files: written, read back


@query("file_voltage", "t long, f long, a long, byte long", "SELECT * FROM dense")
def file_voltage(spark, sf_dir):
    path = scratch_path(spark, "voltage.bin")
    tensors.write_packed_voltage(payloads(spark, sf_dir), path, DENSE)
    hexed = F.hex("payload")
    rows = tensors.read_packed_voltage(spark, path, DENSE).select("t", "f", hexed.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("a"))
    return rows.select("t", "f", "a", F.conv(F.substring("h", 2 * F.col("a") + 1, F.lit(2)), 16, 10).alias("byte"))


@query("file_spectra", "t long, bytes long, total long", "SELECT t, 4 * 32 AS bytes, sum(byte) AS total FROM dense GROUP BY t")
def file_spectra(spark, sf_dir):
    """The same file by spectra, as records of fixed length."""
    path = scratch_path(spark, "spectra.bin")
    tensors.write_packed_voltage(payloads(spark, sf_dir), path, DENSE)
    rows = tensors.read_packed_spectra(spark, path, DENSE).withColumn("h", F.hex("payload"))
    byte = F.transform(F.sequence(F.lit(0), F.lit(4 * 32 - 1)), lambda i: F.conv(F.substring("h", 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    return rows.select("t", F.octet_length("payload").alias("bytes"), F.aggregate(byte, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("file_weights", "b long, f long, a long, wr long, wi long", "SELECT * FROM integer_weights")
def file_weights(spark, sf_dir):
    path, dims = scratch_path(spark, "weights.bin"), Dimensions(1, V.CHANNELS, V.ANTENNAS, 8)
    tensors.write_weights(V.integer_weights(spark, 8), path, dims)
    return tensors.read_weights(spark, path, dims)


@query(
    "file_tiled_weights",
    "f long, tile long, a long, lane long, wr long, wi long",
    """SELECT f_.f, 0 AS tile, a_.a, lane.range AS lane, coalesce(wr, 0) AS wr, coalesce(wi, 0) AS wi FROM range(32) f_(f), range(32) a_(a), range(32) lane
    LEFT JOIN integer_weights w ON w.f = f_.f AND w.a = a_.a AND w.b = lane.range""",
)
def file_tiled_weights(spark, sf_dir):
    path, dims = scratch_path(spark, "tiled.bin"), Dimensions(1, V.CHANNELS, V.ANTENNAS, 8)
    tensors.write_tiled_weights(beamform.tiled(V.integer_weights(spark, 8)), path, dims)
    return tensors.read_tiled_weights(spark, path, dims)


@query("file_intensity", "t long, f long, b long, power long", "SELECT t, f, b, power FROM dense_power UNION ALL SELECT t, f + 4, b, power FROM dense_power")
def file_intensity(spark, sf_dir):
    """Two buffers' files side by side in the band."""
    path = scratch_path(spark, "intensity.bin")
    tensors.write_intensity(dense_power(spark, sf_dir), path, DENSE)
    return tensors.read_two_shards(spark, [path, path], DENSE)


@query(
    "file_quantized",
    "w long, f long, b long, code long, value d2",
    """SELECT w, f, b, code, CAST("offset" AS FLOAT)::DOUBLE + CAST(scale AS FLOAT)::DOUBLE * code AS value FROM
    (SELECT w, f, b, "offset", scale, CASE WHEN scale = 0 THEN 0 ELSE greatest(-127, least(127, round_even((power - "offset") / scale, 0))) END AS code
    FROM (SELECT t AS w, f, b, power FROM dense_power) JOIN dense_tiles USING (w))""",
)
def file_quantized(spark, sf_dir):
    """Codes and their parameters through two files, and back to values."""
    values = dense_power(spark, sf_dir).withColumnRenamed("t", "w")
    codes, side = scratch_path(spark, "codes.bin"), scratch_path(spark, "parameters.bin")
    tensors.write_quantized(quantize.quantize(values), codes, DENSE)
    tensors.write_quantization_parameters(quantize.tile_parameters(values), side, DENSE)
    back = quantize.with_tile(tensors.read_quantized(spark, codes, DENSE)).join(tensors.read_quantization_parameters(spark, side, DENSE), ["w", "ft", "bt"])
    return back.select("w", "f", "b", "code", S.dequantize(F.col("code"), F.col("offset").cast("double"), F.col("scale").cast("double")).alias("value"))


# --- tensors that grow with the table: eight keys to a spectrum, 8 channels, 32 elements

KEYS, BAND = 8, 8


def long_dims(spark, sf_dir):
    """One pass for the largest key: as many spectra as the keys need."""
    last = V.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return Dimensions(1 + (last or 0) // KEYS, BAND, V.ANTENNAS, 8)


def long_frames(spark, sf_dir, dims):
    """(t, f, payload): bytes of a place added up; places without line items are zero."""
    byte = (F.sum("byte") % 256).cast("int").alias("byte")
    rows = V.voltage(spark, sf_dir).groupBy(F.floor(F.col("t") / KEYS).alias("t"), (F.col("f") % BAND).alias("f"), "a").agg(byte)
    grid = spark.range(dims.n_time * dims.n_freq).select(F.floor(F.col("id") / BAND).alias("t"), (F.col("id") % BAND).cast("int").alias("f"))
    there = grid.join(beamform.to_frames(rows, dims.n_ant), ["t", "f"], "left")
    return there.select("t", "f", F.coalesce("payload", F.unhex(F.lit("00" * dims.n_ant))).alias("payload"))


def long_power(spark, sf_dir, path):
    """(dims, power): the raw tensor of the line items, written and read by ranges, through the weights of its channels."""
    dims = long_dims(spark, sf_dir)
    tensors.write_packed_voltage(long_frames(spark, sf_dir, dims), path, dims)
    cube = beamform.weight_cube(V.integer_weights(spark, dims.n_beams, BAND), dims.n_beams, BAND, dims.n_ant)
    return dims, beamform.frame_power(tensors.read_packed_voltage(spark, path, dims), cube)


V.SQL |= {
    "long_samples": f"""SELECT t, f, a, (((byte & 15) + 8) % 16) - 8 AS re, (((byte >> 4) + 8) % 16) - 8 AS im FROM
        (SELECT t // {KEYS} AS t, f % {BAND} AS f, a, CAST(sum(byte) % 256 AS INTEGER) AS byte FROM voltage GROUP BY 1, 2, 3)""",
    "long_sums": """SELECT t, f, b, CAST(sr * sr + si * si AS BIGINT) AS power FROM
        (SELECT t, f, b, sum(wr * re - wi * im) AS sr, sum(wr * im + wi * re) AS si FROM long_samples JOIN integer_weights USING (f, a) GROUP BY t, f, b)""",
    "long_grid": f"SELECT t.range AS t, f.range AS f, b.range AS b FROM (SELECT unnest(range(1 + max(l_orderkey) // {KEYS})) AS range FROM lineitem) t, range({BAND}) f, range(8) b",
    "long_power": "SELECT g.t, g.f, g.b, coalesce(power, 0) AS power FROM long_grid g LEFT JOIN long_sums s ON s.t = g.t AND s.f = g.f AND s.b = g.b",
    "long_windows": "SELECT t // 64 AS w, f, b, CAST(sum(power) AS DOUBLE) AS power FROM long_power GROUP BY 1, 2, 3",
    "long_range": "SELECT w, f // 16 AS ft, b // 16 AS bt, min(power) AS low, max(power) AS high FROM long_windows GROUP BY 1, 2, 3",
    "long_tiles": """SELECT w, CASE WHEN low = high THEN low ELSE low + 127.5::DOUBLE * ((high - low) / 255.0::DOUBLE) END AS "offset",
        (high - low) / 255.0::DOUBLE AS scale FROM long_range""",
}


@query("tensor_beams", "w long, f long, b long, power long", "SELECT t // 64 AS w, f, b, sum(power) AS power FROM long_power GROUP BY 1, 2, 3")
def tensor_beams(spark, sf_dir):
    """A raw voltage tensor as long as the table, read by ranges of frames and integrated."""
    dims, power = long_power(spark, sf_dir, scratch_path(spark, "long-voltage"))
    summed = power.groupBy(F.floor(F.col("t") / 64).alias("w"), "f").agg(*[F.sum(F.col("power")[b].cast("double")).alias(f"b{b}") for b in range(dims.n_beams)])
    return summed.select("w", "f", F.posexplode(F.array(*[f"b{b}" for b in range(dims.n_beams)])).alias("b", "power"))


@query("tensor_intensity", "t long, f long, power long, beams long", "SELECT t, f, sum(power * (b + 1)) AS power, 8 AS beams FROM long_power GROUP BY t, f")
def tensor_intensity(spark, sf_dir):
    """The same tensor's power through a tensor of floats."""
    dims, power = long_power(spark, sf_dir, scratch_path(spark, "long-voltage"))
    path = scratch_path(spark, "long-intensity")
    tensors.write_intensity(power.select("t", "f", F.posexplode("power").alias("b", "power")), path, dims)
    back = tensors.read_intensity(spark, path, dims)
    return back.groupBy("t", "f").agg(F.sum(F.col("power").cast("double") * (F.col("b") + 1)).alias("power"), F.count(F.lit(1)).alias("beams"))


@query(
    "tensor_quantized",
    "w long, f long, b long, code long, value d2",
    """SELECT w, f, b, code, CAST("offset" AS FLOAT)::DOUBLE + CAST(scale AS FLOAT)::DOUBLE * code AS value FROM
    (SELECT w, f, b, "offset", scale, CASE WHEN scale = 0 THEN 0 ELSE greatest(-127, least(127, round_even((power - "offset") / scale, 0))) END AS code
    FROM long_windows JOIN long_tiles USING (w))""",
)
def tensor_quantized(spark, sf_dir):
    """Window sums as codes and parameters of their tiles, both through raw tensors, and back to values."""
    dims, power = long_power(spark, sf_dir, scratch_path(spark, "long-voltage"))
    each = power.select(F.floor(F.col("t") / 64).alias("w"), "f", F.posexplode("power").alias("b", "power"))
    sums = kept(each.groupBy("w", "f", "b").agg(F.sum(F.col("power").cast("double")).alias("power")), "long-windows")
    dims, codes, side = dims.integrated(64), scratch_path(spark, "long-codes"), scratch_path(spark, "long-parameters")
    tensors.write_quantized(quantize.quantize(sums), codes, dims)
    tensors.write_quantization_parameters(quantize.tile_parameters(sums), side, dims)
    back = quantize.with_tile(tensors.read_quantized(spark, codes, dims)).join(tensors.read_quantization_parameters(spark, side, dims), ["w", "ft", "bt"])
    return back.select("w", "f", "b", "code", S.dequantize(F.col("code"), F.col("offset").cast("double"), F.col("scale").cast("double")).alias("value"))


@query(
    "file_metadata",
    "key string, value string",
    """SELECT * FROM (VALUES ('format', 'quantized-int8-v1'), ('n_time', '48'), ('n_freq', '336'), ('n_ant', '64'), ('n_beams', '64'), ('input_n_time', '15360'), ('integration_spectra', '320'),
    ('chunk_time', '1'), ('chunk_frequency', '16'), ('chunk_beam', '16'), ('invalid_code', '-128'), ('parameters_format', 'little-endian-float32[offset,scale]'), ('parameters_file', 'p.bin'),
    ('parameters_count', '4032'), ('shard_id', '1'), ('shard_count', '2'), ('local_frequency_count', '336'), ('absolute_frequency_start', '336'), ('timestamp_start', '0'), ('timestamp_step', '1'),
    ('loss_mask_id', '1'), ('loss_mask_independent', '1')) m(key, value)""",
)
def file_metadata(spark, sf_dir):
    from beamquarry.model import ShardDescriptor

    path, dims = scratch_path(spark, "metadata"), Dimensions().integrated(320)
    tensors.write_metadata(spark, path, tensors.quantized_metadata(dims, 15360, 320, "p.bin", vars(ShardDescriptor.default(1).check())))
    return spark.createDataFrame(sorted(tensors.read_quantized_metadata(spark, path).items()), "key string, value string")


@query(
    "file_shards",
    "shard_id long, t long, f long, bytes long, valid boolean, channel long",
    """SELECT s.range AS shard_id, t, f, 32 AS bytes, (t * 7 + f * 3 + s.range) % 10 <> 0 AS valid, f + 336 * s.range AS channel
    FROM (SELECT DISTINCT t, f FROM dense), range(2) s""",
)
def file_shards(spark, sf_dir):
    """A set of two shards, written by shard, checked and read with descriptors and masks."""
    path, shards = scratch_path(spark, "shards"), synthetic.shard_table(spark).withColumn("local_frequency_count", F.lit(DENSE.n_freq))
    frames = payloads(spark, sf_dir).crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("shard_id"))))
    mask = frames.select("shard_id", "t", "f", ((F.col("t") * 7 + F.col("f") * 3 + F.col("shard_id")) % 10 != 0).alias("valid"))
    tensors.write_packed_shards(frames, mask, shards, path)
    back = tensors.read_packed_shards(spark, path, dims=DENSE)
    return back.select("shard_id", "t", "f", F.octet_length("payload").alias("bytes"), "valid", S.absolute_channel(F.col("absolute_frequency_start"), F.col("f")).alias("channel"))


def text_file(spark, name, rows):
    """Lines of a small table as one text file, with comments and both kinds of separators."""
    path = scratch_path(spark, name)
    lines = rows.select(F.concat(F.concat_ws(", ", *rows.columns[1:]), F.lit("  # "), F.col(rows.columns[0]).cast("string")).alias("value"), rows.columns[0])
    lines.orderBy(rows.columns[0]).coalesce(1).select("value").write.text(path)
    return path


@query("file_positions", "a long, x d6, y d6, z d6", "SELECT * FROM antennas")
def file_positions(spark, sf_dir):
    return tensors.load_positions(spark, text_file(spark, "positions", geometry.antennas(spark, 32)), 32)


@query("file_frequencies", "f long, hz d3", "SELECT * FROM channels")
def file_frequencies(spark, sf_dir):
    return tensors.load_frequencies(spark, text_file(spark, "frequencies", geometry.channels(spark, V.CHANNELS)), V.CHANNELS)


@query("file_directions", "b long, l d9, m d9, n d9", "SELECT * FROM beams")
def file_directions(spark, sf_dir):
    return tensors.load_directions(spark, text_file(spark, "directions", V.beams(spark)), 4)


# --- generators


@query(
    "source_one_hot",
    "shard_id long, t long, f long, a long, byte long",
    """SELECT s.range AS shard_id, t.range AS t, f.range AS f, a.range AS a, CASE WHEN t.range = 1 AND f.range = 2 + s.range AND a.range = 5 * s.range THEN 3 + 16 * 12 ELSE 0 END AS byte
    FROM range(2) s, range(3) t, range(4) f, range(32) a""",
)
def source_one_hot(spark, sf_dir):
    return synthetic.two_shard_one_hot(spark, Dimensions(3, 4, 32, 1), 1, (2, 3), (0, 5), 3, -4)


@query("source_constant", "shard_id long, byte long, n long", "SELECT range AS shard_id, 2 + 16 * 15 AS byte, 3 * 4 * 32 AS n FROM range(2)")
def source_constant(spark, sf_dir):
    return synthetic.two_shard_constant(spark, Dimensions(3, 4, 32, 1), 2, -1).groupBy("shard_id", "byte").agg(F.count(F.lit(1)).alias("n"))


def wave_sql(hz, l, m, tables):  # noqa: E741
    """A wave of amplitude 5 as a packed byte, rounded half away from zero as both engines' round() does."""
    return f"""SELECT *, (CAST(round(5 * cos(phi), 0) AS INTEGER) & 15) + 16 * (CAST(round(-5 * sin(phi), 0) AS INTEGER) & 15) AS byte FROM
    (SELECT *, 2 * pi() / 299792458.0::DOUBLE * {hz} * (x * ({l}) + y * ({m}) + z * sqrt(1.0 - pow({l}, 2) - pow({m}, 2))) AS phi FROM {tables})"""


@query(
    "source_point",
    "shard_id long, t long, f long, a long, byte long",
    f"""SELECT shard_id, t.range AS t, f, a, byte FROM
    ({wave_sql('(hz + shard_id * 336 * 0.3e6)', '0.11::DOUBLE', '-0.07::DOUBLE', '(SELECT range AS shard_id FROM range(2)), (SELECT * FROM channels WHERE f < 4), antennas')}), range(2) t""",
)
def source_point(spark, sf_dir):
    return synthetic.two_shard_point_source(spark, Dimensions(2, 4, 32, 1), 0.11, -0.07, 5.0)


@query(
    "source_moving",
    "t long, f long, a long, byte long",
    wave_sql("hz", "0.02::DOUBLE + t * 0.003::DOUBLE", "0.01::DOUBLE - t * 0.001::DOUBLE", "(SELECT range AS t FROM range(9)), (SELECT * FROM channels WHERE f < 4), antennas"),
)
def source_moving(spark, sf_dir):
    path = Trajectory(0.02, 0.01, 0.003, -0.001)
    return synthetic.moving_source(spark, 9, geometry.channels(spark, 4), geometry.antennas(spark, 32), path, 5.0)


@query("source_noise", "byte_ok long, repeats long, re_mean d0, im_mean d0, spectra long", "SELECT 12 * 4 * 32 AS byte_ok, 12 * 4 * 32 AS repeats, 0 AS re_mean, 0 AS im_mean, 12 AS spectra")
def source_noise(spark, sf_dir):
    """Noise keeps to -7..7 in both components, is even around zero, the same when drawn again, and one spectrum when tiled."""
    one, again = synthetic.noise(spark, DENSE, 9), synthetic.noise(spark, DENSE, 9)
    tiled = synthetic.tiled_noise(spark, DENSE, 9).groupBy("f", "a").agg(F.countDistinct("byte").alias("kinds"), F.count(F.lit(1)).alias("n"))
    spectra = tiled.where("kinds = 1").agg(F.max("n").alias("spectra"))
    re, im = S.unpack_re(F.col("byte")), S.unpack_im(F.col("byte"))
    good = one.agg(F.count_if(F.abs(re).between(0, 7) & F.abs(im).between(0, 7)).alias("byte_ok"), (F.avg(re) / 4).alias("re_mean"), (F.avg(im) / 4).alias("im_mean"))
    same = one.join(again, ["t", "f", "a", "byte"]).agg(F.count(F.lit(1)).alias("repeats"))
    return good.crossJoin(same).crossJoin(spectra).select("byte_ok", "repeats", (F.col("re_mean") + 0.0).alias("re_mean"), (F.col("im_mean") + 0.0).alias("im_mean"), "spectra").select(
        "byte_ok", "repeats", *[F.when(F.abs(c) < 0.5, 0.0).otherwise(F.col(c)).alias(c) for c in ("re_mean", "im_mean")], "spectra"
    )


@query("source_loss_mask", "shard_id long, frames long, in_range boolean", "SELECT range AS shard_id, 400 * 16 AS frames, true AS in_range FROM range(2)")
def source_loss_mask(spark, sf_dir):
    masks = synthetic.two_shard_masks(spark, Dimensions(400, 16, 32, 1), (3, 4), 0.25)
    return masks.groupBy("shard_id").agg(F.count(F.lit(1)).alias("frames"), F.avg((~F.col("valid")).cast("int")).between(0.22, 0.28).alias("in_range"))


@query(
    "source_files",
    "kind string, shard_id long, samples long, total long",
    """SELECT * FROM (VALUES ('constant', 1), ('zero', 0)) k(kind, byte), (SELECT range AS shard_id FROM range(2)), (SELECT 3 * 4 * 32 AS samples), (SELECT 0 AS total) t"""
    .replace("(SELECT 0 AS total) t", "(SELECT 1)").replace("SELECT * FROM", "SELECT kind, shard_id, samples, byte * samples AS total FROM"),
)
def source_files(spark, sf_dir):
    """What the generator of test data writes, by kind."""
    found = []
    for kind in ("constant", "zero"):
        path = scratch_path(spark, "fake")
        synthetic.write_fake_data(spark, path, kind, Dimensions(3, 4, 32, 1))
        found.append(spark.read.parquet(f"{path}/payload").groupBy("shard_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("byte").alias("total")).withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1])


@query(
    "burst_synthesis",
    "t long, f long, power d6",
    """SELECT t.range AS t, f, pow(hz / 800e6, -1.2::DOUBLE - 0.4::DOUBLE * ln(hz / 800e6)) * exp(-0.5::DOUBLE * pow((t.range / 952.381::DOUBLE - 1.5::DOUBLE
    - 4148.808::DOUBLE * 20.0::DOUBLE * (pow(hz / 1e6, -2.0) - pow(800.0::DOUBLE, -2.0))) / 0.02::DOUBLE, 2)) AS power FROM burst_channels, range(4096) t""",
)
def burst_synthesis(spark, sf_dir):
    """A burst without scattering; the convolution with a tail is a test."""
    return burst.synthesize(V.burst_channels(spark), ("x", 20.0, 1.5, 0.02, 0.0, -1.2, -0.4, 10.0), 4096)


# --- scalar functions and small tables


@query(
    "linear_layouts",
    "weight_at long, tiled_at long, intensity_at long, n long",
    """SELECT (b * 32 + f) * 32 + a AS weight_at, ((f * 2 + b // 32) * 32 + a) * 32 + b % 32 AS tiled_at, (t * 32 + f) * 40 + b AS intensity_at, count(*) AS n
    FROM (SELECT t, f, a, (t * 7 + a) % 40 AS b FROM samples) GROUP BY 1, 2, 3""",
)
def linear_layouts(spark, sf_dir):
    t, f, a, b = (F.col(c) for c in "tfab")
    rows = V.samples(spark, sf_dir).withColumn("b", (t * 7 + a) % 40)
    at = [S.weight_index(b, f, a, 32, 32).alias("weight_at"), S.tiled_weight_index(b, f, a, 40, 32).alias("tiled_at"), S.intensity_index(t, f, b, 32, 40).alias("intensity_at")]
    return rows.select(*at).groupBy("weight_at", "tiled_at", "intensity_at").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scalar_laws",
    "vec_id long, sinc2 d9, law d9, db d6, width d6",
    """SELECT vec_id, CASE WHEN x = 0 THEN 1.0 ELSE pow(sin(pi() * x) / (pi() * x), 2) END AS sinc2, pow(r, -1.2::DOUBLE - 0.4::DOUBLE * ln(r)) AS law,
    10 * log10(greatest(x / 2.0::DOUBLE, 1e-8)) AS db, CASE WHEN hz < 400e6 THEN 92.0::DOUBLE + (hz - 300e6) * (16.0::DOUBLE / 100e6) ELSE 108.0::DOUBLE + (hz - 400e6) * (12.0::DOUBLE / 100e6) END AS width
    FROM (SELECT vec_id, (vec_id % 97) / 31.0::DOUBLE AS x, hz / 800e6 AS r, hz FROM (SELECT vec_id, 250e6 + (vec_id % 61) * 7e6 AS hz FROM embeddings))""",
)
def scalar_laws(spark, sf_dir):
    """Beam pattern, spectral law, decibels, and antenna widths between and beyond their anchors."""
    k = F.col("vec_id")
    rows = V.table(spark, sf_dir, "embeddings").select(k, ((k % 97) / 31.0).alias("x"), (F.lit(250e6) + (k % 61) * 7e6).alias("hz"))
    x, hz = F.col("x"), F.col("hz")
    return rows.select(k, S.sinc2(x).alias("sinc2"), S.spectral_law(hz, F.lit(-1.2), F.lit(-0.4)).alias("law"), S.normalized_db(x, F.lit(2.0)).alias("db"), S.antenna_spec(hz, 0).alias("width"))


@query("centered_bins", "count long, low long, high long, n long", "SELECT range + 1 AS count, -((range + 1) // 2) AS low, range - (range + 1) // 2 AS high, range + 1 AS n FROM range(9)")
def centered_bins(spark, sf_dir):
    bins = [(n, min(x), max(x), len(x)) for n in range(1, 10) for x in [geometry.centered_range(n)]]
    return spark.createDataFrame(bins, "count long, low long, high long, n long")


@query(
    "hex_beam_counts",
    "side long, beams long",
    """SELECT side.range AS side, greatest(1, ceil(pi() / (2 * sqrt(3.0::DOUBLE)) * 4 * 0.36::DOUBLE * pow(side.range - 1, 2) * sin(radians(54.0::DOUBLE)) * sin(radians(37.0::DOUBLE)) / 0.5625::DOUBLE)) AS beams
    FROM range(2, 17) side""",
)
def hex_beam_counts(spark, sf_dir):
    return spark.createDataFrame([(n, geometry.hex_beam_estimate(0.6, n, n, 108.0, 74.0, 0.75)) for n in range(2, 17)], "side long, beams long")


@query("fov_axes", "i long, u d9", "SELECT range AS i, -0.4::DOUBLE + range * 0.05::DOUBLE AS u FROM range(17)")
def fov_axes(spark, sf_dir):
    return geometry.fov_axis(spark, 17, 0.4)


@query(
    "search_cells",
    "cell long, l d9, m d9, n d9",
    """SELECT cell, l * p AS l, m * p AS m, sqrt(1.0 - pow(l * p, 2) - pow(m * p, 2)) AS n FROM (SELECT *, CASE WHEN l * l + m * m > 0.999 THEN sqrt(0.999::DOUBLE / (l * l + m * m)) ELSE 1.0 END AS p FROM
    (SELECT range AS cell, 0.8::DOUBLE - 0.3::DOUBLE + (range % 9) * 0.075::DOUBLE AS l, 0.1::DOUBLE - 0.3::DOUBLE + (range // 9) * 0.075::DOUBLE AS m FROM range(81)))""",
)
def search_cells(spark, sf_dir):
    return geometry.centred_grid(spark, 0.8, 0.1, 9, 0.3, 0.3)


@query(
    "sizes",
    "n_time long, windows long, steered long, samples long, weights long, tiled long, outputs long, tiles long, mask long",
    """SELECT n * 336 AS mask, n AS n_time, (n + 319) // 320 AS windows, (n + 319) // 320 AS steered, n * 336 * 64 AS samples, 40 * 336 * 64 AS weights, 64 * 336 * 64 AS tiled, n * 336 * 40 AS outputs, n * 21 * 3 AS tiles
    FROM (SELECT 100 * range + 1 AS n FROM range(20))""",
)
def sizes(spark, sf_dir):
    rows = []
    for n in range(1, 2001, 100):
        d = Dimensions(n, 336, 64, 40)
        rows.append((n, integrated_count(n, 320), window_count(n, 320), d.samples, d.weight_values, d.tiled_weight_values, d.intensity_values, math.prod(quantize.layout(n, 336, 40)), d.mask_bytes))
    return spark.createDataFrame(rows, "n_time long, windows long, steered long, samples long, weights long, tiled long, outputs long, tiles long, mask long")


@query(
    "buffers",
    "buffer string, channels long, first long, label string",
    """SELECT * FROM (VALUES ('0', 336, 0, 'buffer 0: channels 0 to 335'), ('1', 336, 336, 'buffer 1: channels 336 to 671'), ('both', 672, 0, 'buffer both: channels 0 to 671')) b(buffer, channels, first, label)""",
)
def buffers(spark, sf_dir):
    return spark.createDataFrame([(*resolve_channels(b), buffer_label(b)) for b in ("0", "1", "both")], "buffer string, channels long, first long, label string")


# --- tracker, search


@query(
    "overlap_frames",
    "w long, l d9, m d9",
    "SELECT range * 8 AS w, 0.02::DOUBLE + range * 8 * 320 * 1e-5::DOUBLE AS l, -0.03::DOUBLE + range * 8 * 320 * (-2e-6::DOUBLE) AS m FROM range(5)",
)
def overlap_frames(spark, sf_dir):
    return tracker.overlap_series(spark.range(48).select(F.col("id").alias("w")), Trajectory(0.02, -0.03, 1e-5, -2e-6), 320, 8, 5)


@query(
    "tracker_kinematics",
    "t long, l d9, m d9, steered_l d9, steered_m d9, error_arcmin d6",
    """SELECT *, degrees(sqrt(pow(l - steered_l, 2) + pow(m - steered_m, 2))) * 60 AS error_arcmin FROM (SELECT range AS t, -0.15::DOUBLE + range * 2e-5::DOUBLE AS l, -0.1::DOUBLE + range * 1.3e-5::DOUBLE AS m,
    -0.15::DOUBLE + (range // 320) * 320 * 2e-5::DOUBLE AS steered_l, -0.1::DOUBLE + (range // 320) * 320 * 1.3e-5::DOUBLE AS steered_m FROM range(15360))""",
)
def tracker_kinematics(spark, sf_dir):
    return tracker.kinematics(spark, Trajectory(-0.15, -0.1, 2e-5, 1.3e-5), 320, V.CUBE_TIME)


@query(
    "transit_response",
    "n_ant long, i long, deg d6, power d9, db d6",
    """SELECT n_ant, i, deg, power, 10 * log10(greatest(power, 1e-4)) AS db FROM (SELECT n_ant, i, deg, CASE WHEN x = 0 THEN 1.0 ELSE pow(sin(pi() * x) / (pi() * x), 2) END AS power FROM
    (SELECT n_ant, i.range AS i, -3.0::DOUBLE + i.range * (6.0::DOUBLE / 500) AS deg, d / 0.5::DOUBLE * sin(radians(-3.0::DOUBLE + i.range * (6.0::DOUBLE / 500))) AS x
    FROM range(501) i, (VALUES (64, 4.2::DOUBLE), (128, 6.0::DOUBLE), (256, 9.0::DOUBLE)) a(n_ant, d)))""",
)
def transit_response(spark, sf_dir):
    return tracker.transit(spark, 3.0, 501, {64: 4.2, 128: 6.0, 256: 9.0}, 0.5)


@query("window_slice", "t long, f long, power d4", f"SELECT * FROM ({TRACK_SQL.replace('cube_samples', '(SELECT * FROM cube_samples WHERE t // 320 = 7)')})")
def window_slice(spark, sf_dir):
    """One window by itself: its samples alone, and a path that stands still where the window looks."""
    samples = V.cube_samples(spark, sf_dir).where(F.floor(F.col("t") / 320) == 7)
    l, m, _ = Trajectory(0.02, -0.03, 1e-5, -2e-6).at(7 * 320)  # noqa: E741
    directions = tracker.window_directions(samples, Trajectory(l, m), 320)
    return tracker.track(samples, directions, geometry.channels(spark, V.CHANNELS), geometry.antennas(spark, V.ANTENNAS), 320)


BARTLETT_SQL = f"""SELECT w, cell, sum(power) AS power FROM (SELECT t // {FRAME_SPECTRA} AS w, f, cell, avg(sr * sr + si * si) AS power FROM
    (SELECT t, f, cell, sum(cos(phi) * re - sin(phi) * im) AS sr, sum(cos(phi) * im + sin(phi) * re) AS si FROM
        (SELECT t, f, cell, re, im, 2 * pi() / 299792458.0::DOUBLE * hz * (x * l + y * m) AS phi FROM frame_samples JOIN channels USING (f) JOIN antennas USING (a),
        (SELECT range AS cell, -0.2::DOUBLE + (range % 5) * 0.1::DOUBLE AS l, -0.2::DOUBLE + (range // 5) * 0.1::DOUBLE AS m FROM range(25))) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("bartlett_grid", "w long, cell long, power d3", BARTLETT_SQL)
def bartlett_grid(spark, sf_dir):
    cells = geometry.centred_grid(spark, 0.0, 0.0, 5, 0.2, 0.2)
    samples = tensors.decoded(V.frames(spark, sf_dir), V.ANTENNAS)
    return doa.bartlett_relational(samples, cells, geometry.channels(spark, V.CHANNELS), geometry.antennas(spark, V.ANTENNAS), FRAME_SPECTRA)


@query("bartlett_peaks", "w long, l d6, m d6", f"SELECT w, -0.2::DOUBLE + (cell % 5) * 0.1::DOUBLE AS l, -0.2::DOUBLE + (cell // 5) * 0.1::DOUBLE AS m FROM (SELECT w, arg_max(cell, power) AS cell FROM ({BARTLETT_SQL}) GROUP BY w)")
def bartlett_peaks(spark, sf_dir):
    """Strongest cell of each window in frame form: no centre is carried, so windows are searched in parallel."""
    cells = geometry.centred_grid(spark, 0.0, 0.0, 5, 0.2, 0.2)
    look = np.array([(r["l"], r["m"], r["n"]) for r in cells.orderBy("cell").collect()])
    hz = 300e6 + np.arange(V.FRAME_CHANNELS) * 0.3e6
    powers = doa.grid_powers(doa.lag_sums(V.frames(spark, sf_dir), positions(), FRAME_SPECTRA), hz, positions(), look)
    peaks = doa.strongest_cell(powers, cells)
    zero = F.lit(0.0)
    return peaks.select("w", (F.round("l", 6) + zero).alias("l"), (F.round("m", 6) + zero).alias("m"))


@query(
    "search_dump",
    "name string, n long",
    f"""SELECT 'cells' AS name, 25 AS n UNION ALL SELECT 'powers', 25 * count(DISTINCT vec_id // {FRAME_SPECTRA}) FROM embeddings UNION ALL
    SELECT 'covariances', count(*) FROM (SELECT DISTINCT vec_id // {FRAME_SPECTRA}, vec_id % 16 FROM embeddings)""",
)
def search_dump(spark, sf_dir):
    path, cells = scratch_path(spark, "dump"), geometry.centred_grid(spark, 0.0, 0.0, 5, 0.2, 0.2)
    look = np.array([(r["l"], r["m"], r["n"]) for r in cells.orderBy("cell").collect()])
    covs = doa.covariances(V.frames(spark, sf_dir), V.ANTENNAS, FRAME_SPECTRA)
    doa.dump(covs, cells, doa.grid_powers(covs, 300e6 + np.arange(V.FRAME_CHANNELS) * 0.3e6, positions(), look), path)
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name in ("cells", "powers", "covariances")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("search_dump_powers", "w long, l d6, m d6, power d3", f"SELECT w, -0.2::DOUBLE + (cell % 5) * 0.1::DOUBLE AS l, -0.2::DOUBLE + (cell // 5) * 0.1::DOUBLE AS m, power FROM ({BARTLETT_SQL})")
def search_dump_powers(spark, sf_dir):
    """A dump read back: each window's power over the cells that were searched."""
    path, cells = scratch_path(spark, "dump"), geometry.centred_grid(spark, 0.0, 0.0, 5, 0.2, 0.2)
    look = np.array([(r["l"], r["m"], r["n"]) for r in cells.orderBy("cell").collect()])
    lags = doa.lag_sums(V.frames(spark, sf_dir), positions(), FRAME_SPECTRA)
    doa.dump(lags, cells, doa.grid_powers(lags, 300e6 + np.arange(V.FRAME_CHANNELS) * 0.3e6, positions(), look), path)
    return spark.read.parquet(f"{path}/powers").join(F.broadcast(spark.read.parquet(f"{path}/cells")), "cell").select("w", (F.round("l", 6) + F.lit(0.0)).alias("l"), (F.round("m", 6) + F.lit(0.0)).alias("m"), "power")


# --- bursts


@query(
    "dedisperse_unwrapped",
    "t long, power long",
    """SELECT t - s AS t, CAST(sum(power) AS BIGINT) AS power FROM (SELECT t, power, CAST(round_even(4148.808::DOUBLE * 100 * (pow(hz / 1e6, -2.0) - pow(800.0::DOUBLE, -2.0)) * 952.381::DOUBLE, 0) AS BIGINT) AS s
    FROM waterfall JOIN burst_channels USING (f)) WHERE t - s BETWEEN 0 AND 4319 GROUP BY 1""",
)
def dedisperse_unwrapped(spark, sf_dir):
    trial = spark.range(1).select(F.lit(0).alias("trial"), F.lit(100.0).alias("dm"))
    moved = burst.dedisperse(V.waterfall(spark, sf_dir), burst.shifts(V.burst_channels(spark), trial), V.BINS, wrap=False)
    return moved.groupBy("t").agg(F.sum("power").alias("power"))


CHANNEL_SQL = "SELECT f, greatest(sum(power) / 86.0::DOUBLE - 1000.0::DOUBLE / 16, 1e-6) AS power FROM waterfall WHERE t >= 957 AND t < 1043 GROUP BY f"


@query("channel_powers", "f long, power d4", CHANNEL_SQL)
def channel_powers(spark, sf_dir):
    return burst.channel_powers(V.waterfall(spark, sf_dir), 1000, 1000.0, V.BINS, V.BURST_CHANNELS)


@query("spectral_index", "spectral_index d6", f"SELECT regr_slope(ln(power), ln(hz / 800e6)) AS spectral_index FROM ({CHANNEL_SQL}) JOIN burst_channels USING (f)")
def spectral_index(spark, sf_dir):
    return burst.spectral_index(channel_powers(spark, sf_dir), V.burst_channels(spark))


# --- records and logs


@query("buffer_records", "n_ant long, n_beams long, n long", "SELECT n_ant, n_beams, count(*) AS n FROM timings WHERE n_freq = 336 GROUP BY 1, 2")
def buffer_records(spark, sf_dir):
    both = V.timings(spark, sf_dir).withColumn("n_freq", F.explode(F.array(F.lit(336), F.lit(672))))
    return compare.for_buffer(both, "0").groupBy("n_ant", "n_beams").agg(F.count(F.lit(1)).alias("n"))


@query("engine_records", "n long, total d2", "SELECT count(*) AS n, sum(latency_ms) AS total FROM latencies WHERE engine = 'A' AND kernel = 'F'")
def engine_records(spark, sf_dir):
    return compare.records_for(V.latencies(spark, sf_dir), engine="A", kernel="F").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("total"))


@query("mean_measurement", "n_ant long, cpu_ms d4, gpu_kernel_ms d4", "SELECT n_ant, avg(cpu_ms) AS cpu_ms, avg(gpu_kernel_ms) AS gpu_kernel_ms FROM timings GROUP BY 1")
def mean_measurement(spark, sf_dir):
    return compare.mean_measurement(V.timings(spark, sf_dir), ["n_ant"], ["cpu_ms", "gpu_kernel_ms"])


@query("falling_response", "monotonic boolean", "SELECT bool_and(y - before <= 0.05 * first) AS monotonic FROM (SELECT y, lag(y) OVER (ORDER BY x) AS before, first(y) OVER (ORDER BY x) AS first, x FROM (SELECT f AS x, sum(power) AS y FROM sample_power GROUP BY f)) WHERE x < 4 AND before IS NOT NULL")
def falling_response(spark, sf_dir):
    points = V.sample_power(spark, sf_dir).groupBy(F.col("f").alias("x")).agg(F.sum("power").cast("double").alias("y"))
    return compare.falls_monotonically(points, "x", "y")


@query("metrics_file", "name string, value d2, n long", "SELECT engine AS name, max(latency_ms) AS value, 2 AS n FROM latencies GROUP BY engine")
def metrics_file(spark, sf_dir):
    """A metrics file that grew by two runs, read by its header."""
    path = scratch_path(spark, "metrics")
    best = V.latencies(spark, sf_dir).groupBy(F.col("engine").alias("name")).agg(F.max("latency_ms").alias("value"))
    for _ in range(2):
        records.append_metrics(best, path)
    rows = records.require_rows(records.read_records(spark, path, "metrics"), path)
    return rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("benchmark_files", "n_ant long, csv_ms d2, json_ms d2", "SELECT n_ant, sum(cpu_ms) AS csv_ms, sum(cpu_ms) AS json_ms FROM timings GROUP BY 1")
def benchmark_files(spark, sf_dir):
    path = scratch_path(spark, "benchmark")
    records.write_benchmark(V.timings(spark, sf_dir), path)
    csv = records.read_records(spark, f"{path}/csv", "timing").groupBy("n_ant").agg(F.sum("cpu_ms").alias("csv_ms"))
    return csv.join(spark.read.schema(records.SCHEMAS["timing"]).json(f"{path}/json").groupBy("n_ant").agg(F.sum("cpu_ms").alias("json_ms")), "n_ant")


@query(
    "report_file",
    "engine string, burst string, injected_dm d2, recovered_dm d2, dm_error d2, snr d2, scaling_slope d2, passed boolean, hidden long",
    """SELECT engine, kernel AS burst, min(latency_ms) AS injected_dm, max(latency_ms) AS recovered_dm, max(latency_ms) - min(latency_ms) AS dm_error, count(*) AS snr, 0 AS scaling_slope, true AS passed, 0 AS hidden
    FROM latencies GROUP BY 1, 2""",
)
def report_file(spark, sf_dir):
    """Validation reports through JSON: fields with an underscore stay behind, whatever their depth."""
    path, low, high = scratch_path(spark, "report"), F.min("latency_ms"), F.max("latency_ms")
    bursts = V.latencies(spark, sf_dir).groupBy("engine", "kernel").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).cast("double").alias("n"))
    sweep = F.struct(F.col("low").alias("injected_dm"), F.col("high").alias("recovered_dm"), (F.col("high") - F.col("low")).alias("dm_error"), F.col("n").alias("recovered_snr"), F.lit("x").alias("_profile"))
    one = F.struct(F.col("kernel").alias("burst"), F.lit(True).alias("burst_passed"), sweep.alias("test_1_dispersion_sweep"), F.lit(1).alias("_secret"))
    reports = bursts.groupBy("engine").agg(F.collect_list(one).alias("results")).withColumn("_top", F.lit("_"))
    records.write_reports(reports, path, "engine")
    files = f"{path}/*/part-*"
    hidden = spark.read.text(files, wholetext=True).agg(F.count_if(F.contains("value", F.lit('"_'))).alias("hidden"))
    return records.validation_reports(spark, files).crossJoin(hidden)


@query(
    "summary_file",
    "line string",
    """SELECT unnest(['# run', '', '| engine | rows |', '| --- | --- |', '']) AS line UNION ALL SELECT '| ' || engine || ' | ' || count(*) || ' |' FROM latencies GROUP BY engine""",
)
def summary_file(spark, sf_dir):
    path = scratch_path(spark, "summary")
    records.write_summary(V.latencies(spark, sf_dir).groupBy("engine").agg(F.count(F.lit(1)).alias("rows")), path, "run")
    return spark.read.text(f"{path}/markdown").withColumnRenamed("value", "line")


def log_file(spark, name, lines):
    """Text lines of a small table (at, line) as one file."""
    path = scratch_path(spark, name)
    lines.orderBy("at").coalesce(1).select(F.col("line").alias("value")).write.text(path)
    return path


@query(
    "engine_log",
    "n_ant long, threads long, backend string, engine string, latency_ms d2, speedup d2",
    """SELECT 32 * (1 + l_linenumber % 2) AS n_ant, 4 AS threads, 'cpu' AS backend, 'opt_v' || l_linenumber AS engine, round(sum(l_quantity), 2) AS latency_ms, 2.5::DOUBLE AS speedup FROM lineitem GROUP BY l_linenumber""",
)
def engine_log(spark, sf_dir):
    """A log of headings and engine lines, read back by separators."""
    runs = V.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("ms"))
    k = F.col("l_linenumber")
    head = F.format_string("=== n_ant=%d | threads=4 ===", (32 * (1 + k % 2)).cast("int"))
    body = F.format_string("  cpu  opt_v%d : %s ms (2.50x vs cpu naive)", k.cast("int"), F.format_string("%.2f", F.col("ms")))
    lines = runs.select(F.posexplode(F.array(head, body, F.lit("---"))).alias("p", "line"), k).select((k * 3 + F.col("p")).alias("at"), "line")
    return records.engine_log(spark, log_file(spark, "engines", lines))


@query(
    "machine_log",
    "key string, value string",
    """SELECT * FROM (VALUES ('hostname', 'node7'), ('date', 'Mon 1 Jan 10:20:30'), ('cpu_model', 'Some CPU @ 3.00GHz'), ('num_cores', '8'), ('gpu_model', '0  Quadro P1000'),
    ('cuda_version', 'CUDA 12.2 (Driver 535.104.05)')) e(key, value)""".replace("0  Quadro P1000", "Quadro P1000"),
)
def machine_log(spark, sf_dir):
    text = ["Host: node7", "Date: Mon 1 Jan 10:20:30", "Model name:          Some CPU @ 3.00GHz", "CPU(s):              8", "NUMA node0 CPU(s):   0-7",
            "| NVIDIA-SMI 535.104.05   Driver Version: 535.104.05   CUDA Version: 12.2     |", "|   0  Quadro P1000        Off  | 00000000:01:00.0 Off |"]
    return records.environment(spark, log_file(spark, "machine", spark.createDataFrame(list(enumerate(text)), "at long, line string")))


@query("suite_logs", "suite string, passed long, total long, status string", "SELECT * FROM (VALUES ('ctest', 19, 21, 'FAILED'), ('naive', NULL, NULL, 'PASSED'), ('python', 37, 37, 'PASSED')) s(suite, passed, total, status)")
def suite_logs(spark, sf_dir):
    def log(name, *text):
        return log_file(spark, name, spark.createDataFrame(list(enumerate(text)), "at long, line string")) + "/part-*"

    ctest = records.test_totals(spark, log("ctest", "1/21 Test #1: a ... Passed", "90% tests passed, 2 tests failed out of 21", "Total time"))
    naive = records.suite_status(spark, log("naive", "[correctness] PASS"), "naive")
    python = records.suite_status(spark, log("python", "Ran 37 tests in 3.2s", "", "OK"), "python")
    rest = naive.unionByName(python).select("suite", F.col("ran").alias("passed"), F.col("ran").alias("total"), "status")
    return ctest.select(F.lit("ctest").alias("suite"), "passed", "total", "status").unionByName(rest)


@query(
    "wide_summary",
    "n_ant string, engine string, latency_median_ms d2, speedup_vs_cpu_naive d2, speedup_vs_cpu_opt_v2 d2",
    """, m AS (SELECT n_ant, round(median(cpu_ms), 2) AS c, round(median(gpu_kernel_ms), 2) AS g FROM timings GROUP BY 1)
    SELECT n_ant, 'CPU Naive' AS engine, c AS latency_median_ms, 1.0 AS speedup_vs_cpu_naive, 1.0 AS speedup_vs_cpu_opt_v2 FROM m UNION ALL
    SELECT n_ant, 'CPU Opt v2', g, 3.5, 1.0 FROM m""",
)
def wide_summary(spark, sf_dir):
    """Medians are selected where the values are; a row for each antenna count is stored, and that alone goes into one file."""
    path = scratch_path(spark, "wide")
    medians = percentiles(V.timings(spark, sf_dir), ["n_ant"], {"naive_ms": ("cpu_ms", 0.5, "linear"), "cpu_v2_ms": ("gpu_kernel_ms", 0.5, "linear")})
    sums = kept(medians.select("n_ant", F.round("naive_ms", 2).alias("naive_ms"), F.round("cpu_v2_ms", 2).alias("cpu_v2_ms")), "medians")
    sums.withColumn("speedup_v2_vs_naive", F.lit(3.5)).coalesce(1).write.csv(path, header=True)
    return records.wide_summary(spark, path)


@query("metadata_json", "engine string, n_ant long", "SELECT 'fws' AS engine, 64 AS n_ant")
def metadata_json(spark, sf_dir):
    lines = ["{", '  "engine": "fws",', '  "n_ant": 64', "}"]
    return records.load_metadata(spark, log_file(spark, "metadata", spark.createDataFrame(list(enumerate(lines)), "at long, line string")))


# --- streams


@query("announced_frames", "frame_id long, shard_id long", "SELECT vec_id AS frame_id, vec_id % 2 AS shard_id FROM embeddings WHERE vec_id % 3 <> 0")
def announced_frames(spark, sf_dir):
    """Frames whose announcement fits; where both leave the type open, that is a match too."""
    k = F.col("vec_id")
    frames = V.table(spark, sf_dir, "embeddings").select(k.alias("frame_id"), (k % 2).alias("shard_id"), F.when(k % 5 != 0, "uint8").alias("dtype"), F.lit("1x64").alias("shape"))
    announced = frames.withColumn("shape", F.when(F.col("frame_id") % 3 == 0, "2x32").otherwise(F.col("shape")))
    return windows.frame_matches(frames, announced)


@query(
    "stream_whole_windows",
    "w long, f long, power long, n long",
    "SELECT w, f, sum(power) AS power, 64 AS n FROM (SELECT t.range // 64 AS w, f.range AS f, (t.range * 7 + f.range * 3) % 11 AS power FROM range(400) t, range(4) f) WHERE w < 6 GROUP BY 1, 2",
)
def stream_whole_windows(spark, sf_dir):
    """Micro-batches of 100 spectra against windows of 64: windows that straddle two batches are kept open, the last one is not full."""
    source, out = scratch_path(spark, "batches"), scratch_path(spark, "windows")
    t, f = F.floor(F.col("id") / 4), F.col("id") % 4
    rows = spark.range(1600).select(t.alias("t"), f.cast("int").alias("f"), ((t * 7 + f * 3) % 11).cast("long").alias("power"))
    for k in range(4):
        rows.where(F.floor(F.col("t") / 100) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = windows.batched_windows(stream, 64, windows.by_batch(out), f"{out}-state", late_samples=400)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_vector_windows", "w long, f long, power long, n long", "SELECT vec_id // 64 AS w, 0 AS f, sum(vec_id * 7 % 11 + label) AS power, 64 AS n FROM embeddings GROUP BY 1 HAVING count(*) = 64")
def stream_vector_windows(spark, sf_dir):
    """The vectors as a stream of spectra: whole windows of 64, each batch in a folder of its own."""
    out, path = scratch_path(spark, "vector-windows"), f"{sf_dir}/embeddings.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).format("parquet").load(path if is_folder(spark, path) else f"{sf_dir}/embeddings.parque[t]")
    rows = stream.select(F.col("vec_id").alias("t"), F.lit(0).alias("f"), (F.col("vec_id") * 7 % 11 + F.col("label")).alias("power"))
    windows.batched_windows(rows, 64, windows.by_batch(out), f"{out}-state", late_samples=1_000_000).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("w long, f int, power long, n long").parquet(out)


# --- joins by nearness


@query(
    "channel_specifications",
    "l_orderkey long, l_linenumber long, gain d4, width d4",
    """, a AS (SELECT o_custkey::DOUBLE AS hz, max(o_totalprice)::DOUBLE AS gain, count(*)::DOUBLE AS width FROM orders GROUP BY o_custkey),
    o AS (SELECT *, row_number() OVER (ORDER BY hz) AS i, count(*) OVER () AS n FROM a),
    r AS (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS hz FROM lineitem),
    k AS (SELECT r.*, least(greatest(coalesce(o.i, 1), 1), (SELECT max(n) - 1 FROM o)) AS i FROM r ASOF LEFT JOIN o ON r.hz >= o.hz)
    SELECT l_orderkey, l_linenumber, p.gain + (k.hz - p.hz) * ((q.gain - p.gain) / (q.hz - p.hz)) AS gain, p.width + (k.hz - p.hz) * ((q.width - p.width) / (q.hz - p.hz)) AS width
    FROM k JOIN o p ON p.i = k.i JOIN o q ON q.i = k.i + 1""",
)
def channel_specifications(spark, sf_dir):
    """Channels (parts) between specified ones (customers): gain and width on straight lines, which go on beyond the ends."""
    orders = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("double").alias("hz"))
    anchors = orders.agg(F.max(F.col("o_totalprice").cast("double")).alias("gain"), F.count(F.lit(1)).cast("double").alias("width"))
    channels = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("hz"))
    return asof.interpolated(channels, anchors, "hz", ["gain", "width"])


@query(
    "direction_errors_by_window",
    "mean_prior_error d9, mean_error d9, mean_error_arcmin d6",
    """, t AS (SELECT f.l AS le, f.m AS me, 0.02::DOUBLE + 64 * w * 1e-8::DOUBLE AS l, -0.03::DOUBLE + 64 * w * -2e-9::DOUBLE AS m, 0.02::DOUBLE AS lp, -0.03::DOUBLE AS mp FROM found f)
    SELECT avg(sqrt(pow(l - lp, 2) + pow(m - mp, 2))) AS mean_prior_error, avg(sqrt(pow(l - le, 2) + pow(m - me, 2))) AS mean_error,
    avg(degrees(sqrt(pow(l - le, 2) + pow(m - me, 2))) * 60) AS mean_error_arcmin FROM t""",
)
def direction_errors_by_window(spark, sf_dir):
    """Path, start and search of each window, from three tables."""
    found = searched(spark, sf_dir, SearchConfig(spectra=FRAME_SPECTRA))
    seen = V.frames(spark, sf_dir).select(F.floor(F.col("t") / FRAME_SPECTRA).cast("long").alias("w")).distinct()
    still = Trajectory(STILL.l0, STILL.m0)
    return compare.direction_errors(compare.joined_directions(tracker.steer(seen, STILL, FRAME_SPECTRA), tracker.steer(seen, still, FRAME_SPECTRA), found))


@query("search_settings", "estimator string, grid long", "SELECT * FROM (VALUES ('bartlett', 16), ('capon', 1)) s(estimator, grid)")
def search_settings(spark, sf_dir):
    """Settings that pass their check; the others are tests."""
    found = [SearchConfig().check(32), SearchConfig(grid=1, estimator="capon").check(32)]
    return spark.createDataFrame([(c.estimator, c.grid) for c in found], "estimator string, grid long")
