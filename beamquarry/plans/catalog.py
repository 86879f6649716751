"""All registered array-processing queries and the SQL that checks them."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import LIGHT_M_S, SearchConfig, Trajectory
from beamquarry.operators import beamform, burst, compare, doa, geometry, quantize, tracker
from beamquarry.plans import views as V
from beamquarry.session import kept, scratch_path
from beamquarry.streaming import windows

QUERIES = {}
ORACLE = {}

SPECTRA, FRAME_SPECTRA = 320, 64
PATH = Trajectory(0.02, -0.03, 1e-5, -2e-6)
LOOK = 2 * math.pi / LIGHT_M_S
#: A slow path for vectors, whose numbers go on beyond a cube.
STILL = Trajectory(0.02, -0.03, 1e-8, -2e-9)


def query(name, columns, sql=None):
    """Register a query under the columns that it returns, with the SQL for the same rows."""

    def add(f):
        def run(spark, sf_dir):
            return V.shaped(f(spark, sf_dir), columns)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = V.sql(columns, sql)
        return f

    return add


# --- samples


@query("int4_decode", "t long, f long, a long, re long, im long", "SELECT * FROM samples")
def int4_decode(spark, sf_dir):
    return V.samples(spark, sf_dir)


@query("int4_pack_roundtrip", "byte long, packed long, n long", "SELECT byte, byte AS packed, count(*) AS n FROM voltage GROUP BY byte")
def int4_pack_roundtrip(spark, sf_dir):
    byte = F.col("byte")
    return V.voltage(spark, sf_dir).groupBy("byte").agg(F.count(F.lit(1)).alias("n")).withColumn("packed", S.pack(S.unpack_re(byte), S.unpack_im(byte)))


@query(
    "voltage_power_by_window",
    "w long, f long, power long, spectra_summed long",
    "SELECT t // 320 AS w, f, sum(power) AS power, count(*) AS spectra_summed FROM sample_power GROUP BY 1, 2",
)
def voltage_power_by_window(spark, sf_dir):
    return beamform.integrate(V.sample_power(spark, sf_dir), SPECTRA, ("f",))


@query(
    "linear_indices",
    "voltage_at long, element long, full_channel long, n long",
    """SELECT (t * 32 + f) * 32 + a AS voltage_at, (2 - 1 - a % 2) * 32 + a AS element, (a % 2) * 336 + f AS full_channel, count(*) AS n
    FROM samples GROUP BY 1, 2, 3""",
)
def linear_indices(spark, sf_dir):
    t, f, a = F.col("t"), F.col("f"), F.col("a")
    places = V.samples(spark, sf_dir).select(
        S.voltage_index(t, f, a, V.CHANNELS, V.ANTENNAS).alias("voltage_at"), S.digitizer_element(a % 2, a, 64).alias("element"), S.full_band_channel(a % 2, f).alias("full_channel")
    )
    return places.groupBy("voltage_at", "element", "full_channel").agg(F.count(F.lit(1)).alias("n"))


# --- beams


def steered(spark, beams=4):
    return beamform.steering_weights(V.beams(spark, beams), geometry.channels(spark, V.CHANNELS), geometry.antennas(spark, V.ANTENNAS))


def integer_power(spark, sf_dir):
    return beamform.beamform_packed(V.voltage(spark, sf_dir), V.integer_weights(spark, 8))


def window_power(spark, sf_dir):
    return beamform.beamform_windows(V.voltage(spark, sf_dir), V.integer_weights(spark, 8), SPECTRA)


def integrated(spark, sf_dir):
    sums = beamform.integrate(window_power(spark, sf_dir), SPECTRA)
    return sums.withColumn("power", F.col("power").cast("double"))


@query("beamform_relational", "t long, f long, b long, power d4", "SELECT * FROM intensity")
def beamform_relational(spark, sf_dir):
    return beamform.beamform_packed(V.voltage(spark, sf_dir), steered(spark))


@query(
    "beamform_integrated",
    "w long, f long, b long, power d3, spectra_summed long",
    "SELECT t // 320 AS w, f, b, sum(power) AS power, count(*) AS spectra_summed FROM intensity GROUP BY 1, 2, 3",
)
def beamform_integrated(spark, sf_dir):
    return beamform.integrate(beamform.beamform_windows(V.voltage(spark, sf_dir), steered(spark), SPECTRA), SPECTRA)


def frame_cube(spark):
    return beamform.weight_cube(V.integer_weights(spark, 8), 8, V.CHANNELS, V.ANTENNAS)


@query("beamform_frames", "t long, f long, b long, power long", "SELECT * FROM frame_power")
def beamform_frames(spark, sf_dir):
    power = beamform.frame_power(V.frames(spark, sf_dir), frame_cube(spark))
    return power.select("t", "f", F.posexplode("power").alias("b", "power"))


@query("beamform_frames_integrated", "w long, f long, b long, power long", "SELECT t // 64 AS w, f, b, sum(power) AS power FROM frame_power GROUP BY 1, 2, 3")
def beamform_frames_integrated(spark, sf_dir):
    return beamform.frame_integrated(V.frames(spark, sf_dir), frame_cube(spark), FRAME_SPECTRA)


@query(
    "loss_mask_filtered",
    "t long, f long, b long, power long",
    "SELECT * FROM integer_power WHERE (t * 7 + f * 3) % 10 <> 0",
)
def loss_mask_filtered(spark, sf_dir):
    """Frames that were lost leave before their samples are multiplied."""
    samples = beamform.decode(beamform.dealt(V.voltage(spark, sf_dir), ("t", "f"), beamform.LANES))
    mask = samples.select("t", "f").distinct().withColumn("valid", (F.col("t") * 7 + F.col("f") * 3) % 10 != 0)
    return beamform.beamform(beamform.apply_loss_mask(samples, mask), V.integer_weights(spark, 8))


@query(
    "tiled_weights",
    "f long, tile long, a long, lane long, wr long, wi long",
    """SELECT f, 0 AS tile, a, lane.range AS lane, coalesce(wr, 0) AS wr, coalesce(wi, 0) AS wi FROM range(32) f_(f), range(32) a_(a), range(32) lane
    LEFT JOIN integer_weights w ON w.f = f_.f AND w.a = a_.a AND w.b = lane.range""".replace("SELECT f, 0 AS tile, a,", "SELECT f_.f, 0 AS tile, a_.a,"),
)
def tiled_weights(spark, sf_dir):
    return beamform.tiled(V.integer_weights(spark, 8))


@query(
    "steering_weights",
    "b long, f long, a long, wr d6, wi d6",
    "SELECT * FROM weights",
)
def steering_weights(spark, sf_dir):
    return steered(spark)


# --- tracker

def track_sql(path, spectra, samples):
    return f"""
    SELECT t, f, sr * sr + si * si AS power FROM (
        SELECT t, f, sum(cos(phi) * re - sin(phi) * im) AS sr, sum(cos(phi) * im + sin(phi) * re) AS si FROM (
            SELECT t, f, re, im, 2 * pi() / 299792458.0::DOUBLE * hz * (x * l + y * m + z * sqrt(1.0 - l * l - m * m)) AS phi FROM (
                SELECT *, {path.l0}::DOUBLE + ((t // {spectra}) * {spectra}) * {path.l_rate}::DOUBLE AS l, {path.m0}::DOUBLE + ((t // {spectra}) * {spectra}) * ({path.m_rate}::DOUBLE) AS m
                FROM {samples} JOIN channels USING (f) JOIN antennas USING (a)))
        GROUP BY t, f)"""


TRACK_SQL = track_sql(PATH, SPECTRA, "cube_samples")


@query("tracker_power", "t long, f long, power d4", TRACK_SQL)
def tracker_power(spark, sf_dir):
    PATH.check(V.CUBE_TIME, SPECTRA)
    return tracker.track(V.cube_samples(spark, sf_dir), PATH, geometry.channels(spark, V.CHANNELS), geometry.antennas(spark, V.ANTENNAS), SPECTRA)


@query(
    "tracker_directions",
    "w long, l d9, m d9, n d9",
    f"""SELECT w, l, m, sqrt(1.0 - l * l - m * m) AS n FROM
    (SELECT range AS w, {PATH.l0}::DOUBLE + range * 320 * {PATH.l_rate}::DOUBLE AS l, {PATH.m0}::DOUBLE + range * 320 * ({PATH.m_rate}::DOUBLE) AS m FROM range(48))""",
)
def tracker_directions(spark, sf_dir):
    return tracker.all_windows(spark, PATH, SPECTRA, V.CUBE_TIME)


@query("tracker_frames", "t long, f long, power d3", track_sql(STILL, FRAME_SPECTRA, "frame_samples"))
def tracker_frames(spark, sf_dir):
    """Frame form of the tracker in double precision; several frames of a place are told apart by their vector, so each is one output."""
    frames = V.frames(spark, sf_dir)
    return tracker.run_engine("frame_precise", frames, STILL, geometry.channels(spark, V.FRAME_CHANNELS), geometry.antennas(spark, V.ANTENNAS), FRAME_SPECTRA)


def positions():
    a = np.arange(V.ANTENNAS)
    return np.stack([a % 8 * 0.6, a // 8 * 0.6, a * 0.0], axis=1)


# --- integration, quantizer, marginals


@query(
    "two_stage_integration",
    "w long, f long, b long, two_stage long, one_stage long",
    "SELECT t // 320 AS w, f, b, sum(power) AS two_stage, sum(power) AS one_stage FROM integer_power GROUP BY 1, 2, 3",
)
def two_stage_integration(spark, sf_dir):
    """Power is made once, where its window's samples are, and grouped by both lengths there; only the short sums are summed again."""
    short = F.explode(F.array(F.floor(F.col("t") / 32).cast("long"), F.lit(None))).alias("short")  # null: the whole window
    sums = window_power(spark, sf_dir).select("w", "f", "b", "power", short).groupBy("w", "short", "f", "b").agg(F.sum("power").alias("power"))
    one, two = (F.sum(F.when(whole, F.col("power"))).alias(name) for whole, name in ((F.col("short").isNull(), "one_stage"), (F.col("short").isNotNull(), "two_stage")))
    return sums.groupBy("w", "f", "b").agg(two, one)


@query("peak_beam", "b long, total long", "SELECT b, sum(power) AS total FROM integer_power GROUP BY b ORDER BY total DESC, b LIMIT 1")
def peak_beam(spark, sf_dir):
    return compare.peak_beam(integer_power(spark, sf_dir))


@query(
    "top_beams",
    "b long, total long, relative d6",
    """SELECT b, total, CAST(total AS DOUBLE) / max(total) OVER () AS relative FROM
    (SELECT b, sum(power) AS total FROM integer_power GROUP BY b ORDER BY total DESC, b LIMIT 5)""",
)
def top_beams(spark, sf_dir):
    return compare.top_beams(integer_power(spark, sf_dir), 5)


@query("tile_params", "w long, ft long, bt long, offset d4, scale d6", "SELECT * FROM tiles")
def tile_params(spark, sf_dir):
    return quantize.tile_parameters(integrated(spark, sf_dir))


@query("quantize_codes", "w long, f long, b long, code long", "SELECT * FROM codes")
def quantize_codes(spark, sf_dir):
    return quantize.quantize(integrated(spark, sf_dir))


@query("dequantize", "w long, f long, b long, value d4", "SELECT w, f, b, c AS value FROM pairs")
def dequantize(spark, sf_dir):
    codes = quantize.quantize(integrated(spark, sf_dir))  # each with its tile's offset and scale
    return codes.select("w", "f", "b", S.dequantize(F.col("code"), F.col("offset"), F.col("scale")).alias("value"))


@query(
    "quantization_stats",
    "finite_samples long, invalid_samples long, max_abs_error d4, mean_abs_error d4, min_code_samples long, max_code_samples long, nrmse d8",
    """SELECT count(*) AS finite_samples, 0 AS invalid_samples, max(abs(c - r)) AS max_abs_error, avg(abs(c - r)) AS mean_abs_error,
    (SELECT count(*) FROM codes WHERE code = -127) AS min_code_samples, (SELECT count(*) FROM codes WHERE code = 127) AS max_code_samples,
    sqrt(sum((c - r) * (c - r)) / sum(r * r)) AS nrmse FROM pairs""",
)
def quantization_stats(spark, sf_dir):
    return quantize.stats(quantize.quantize(integrated(spark, sf_dir)))


@query(
    "marginals_grouping_sets",
    "axis string, at long, power long",
    """SELECT 't' AS axis, t AS at, sum(power) AS power FROM integer_power GROUP BY t UNION ALL
    SELECT 'f', f, sum(power) FROM integer_power GROUP BY f UNION ALL SELECT 'b', b, sum(power) FROM integer_power GROUP BY b""",
)
def marginals_grouping_sets(spark, sf_dir):
    return compare.marginals(integer_power(spark, sf_dir))


@query(
    "shard_union_marginals",
    "f long, power long, samples long",
    "SELECT f + 336 * (t % 2) AS f, sum(power) AS power, count(*) AS samples FROM sample_power GROUP BY 1",
)
def shard_union_marginals(spark, sf_dir):
    """Two shards, told apart by even and odd sample numbers, side by side in the band."""
    power = V.sample_power(spark, sf_dir)
    shards = [power.where(F.col("t") % 2 == k).withColumn("f", S.full_band_channel(F.lit(k), F.col("f"))) for k in (0, 1)]
    return shards[0].unionByName(shards[1]).groupBy("f").agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("samples"))


#: Frames of two shards, by even and odd vectors; planted faults: vectors divisible by 7 lose a byte, those divisible by 11 have no mask value.
FAULT_SQL = """
    , held AS (SELECT vec_id % 2 AS shard_id, count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS short, count(*) FILTER (vec_id % 11 = 0) AS unset FROM embeddings GROUP BY 1),
    frames AS (SELECT (SELECT max(n) FROM held) AS want)
    SELECT 'payload size' AS fault, count(*) AS n FROM held, frames WHERE n <> want OR short > 0 HAVING count(*) > 0 UNION ALL
    SELECT 'mask size', count(*) FROM held, frames WHERE n <> want HAVING count(*) > 0 UNION ALL
    SELECT 'mask value', count(*) FROM held WHERE unset > 0 HAVING count(*) > 0 UNION ALL
    SELECT 'frequency origin', 1 UNION ALL SELECT 'descriptor', 2
"""


@query("shard_faults", "fault string, n long", FAULT_SQL)
def shard_faults(spark, sf_dir):
    """Two shards of real frames with planted faults: short payloads, masks without value, one origin for both, channels that are not the set's."""
    from beamquarry.model import Dimensions
    from beamquarry.sources import synthetic, tensors

    frames = V.frames(spark, sf_dir).withColumn("shard_id", (F.col("t") % 2).cast("int"))
    most = frames.groupBy("shard_id").count().agg(F.max("count")).first()[0]
    payload = frames.withColumn("payload", F.when(F.col("t") % 7 == 0, F.expr("substring(payload, 1, octet_length(payload) - 1)")).otherwise(F.col("payload")))
    shards = synthetic.shard_table(spark).withColumn("absolute_frequency_start", F.lit(0))
    mask = frames.select("shard_id", "t", "f", F.when(F.col("t") % 11 != 0, True).alias("valid"))
    return tensors.shard_faults(payload, mask, shards, Dimensions(most, 1, V.ANTENNAS, 1))


# --- geometry


@query("array_positions", "a long, x d9, y d9, z d9", "SELECT range AS a, (range % 8) * 0.6::DOUBLE AS x, (range // 8) * 0.6::DOUBLE AS y, 0.0::DOUBLE AS z FROM range(64)")
def array_positions(spark, sf_dir):
    return geometry.antennas(spark, 64)


@query("channel_plan", "f long, hz d3", "SELECT range AS f, 300e6 + range * 0.3e6 AS hz FROM range(336)")
def channel_plan(spark, sf_dir):
    return geometry.channels(spark, 336)


@query(
    "beam_grid_line",
    "b long, l d9, m d9, n d9",
    "SELECT range AS b, (range - 32) * 0.02::DOUBLE AS l, 0.0::DOUBLE AS m, sqrt(1.0 - pow((range - 32) * 0.02::DOUBLE, 2)) AS n FROM range(64)",
)
def beam_grid_line(spark, sf_dir):
    return geometry.line_beams(spark, 64)


GRID_STEP = f"{LIGHT_M_S!r}::DOUBLE / 400e6"


@query(
    "beam_grid_fft",
    "b long, l d9, m d9, n d9",
    f"""SELECT row_number() OVER (ORDER BY round(r2, 12), l, m) - 1 AS b, l, m, sqrt(1.0 - l * l - m * m) AS n FROM
    (SELECT *, l * l + m * m AS r2 FROM (SELECT (u.range - 6) * ({GRID_STEP} / (2 * 8 * 0.6::DOUBLE)) AS l, (v.range - 5) * ({GRID_STEP} / (2 * 8 * 0.6::DOUBLE)) AS m
    FROM range(12) u, range(11) v)) QUALIFY b < 128""",
)
def beam_grid_fft(spark, sf_dir):
    return geometry.fft_beams(spark, 64, 128)


@query(
    "beam_grid_rectangular",
    "b long, l d9, m d9, n d9",
    f"""SELECT b, l, m, sqrt(1.0 - l * l - m * m) AS n FROM (SELECT range AS b, (range % 8 - 3.5::DOUBLE) * ({GRID_STEP} / (8 * 0.6::DOUBLE)) AS l,
    (range // 8 - 3.5::DOUBLE) * ({GRID_STEP} / (8 * 0.6::DOUBLE)) AS m FROM range(64))""",
)
def beam_grid_rectangular(spark, sf_dir):
    return geometry.rectangular_beams(spark, 64)


HEX_SQL = """
    WITH tries AS (SELECT range AS k, sqrt(2 * pi() / (sqrt(3.0::DOUBLE) * 128)) * pow(0.9::DOUBLE, range) AS d FROM range(10)),
    points AS (SELECT k, x, y FROM (SELECT k, i.range * d + CASE WHEN j.range % 2 = 0 THEN 0.0 ELSE d / 2 END AS x, j.range * (d * sqrt(3.0::DOUBLE) / 2) AS y
        FROM tries, range(-60, 61) i, range(-60, 61) j) WHERE x * x + y * y <= 1),
    enough AS (SELECT min(k) AS k FROM (SELECT k FROM points GROUP BY k HAVING count(*) >= 128))
    SELECT row_number() OVER (ORDER BY round(l * l + m * m, 12), l, m) - 1 AS b, l, m FROM (SELECT x * 0.8::DOUBLE AS l, y * 0.6::DOUBLE AS m FROM points JOIN enough USING (k)) QUALIFY b < 128
"""


@query("beam_grid_hex", "b long, l d9, m d9", HEX_SQL.strip().replace("WITH tries", ", tries", 1))
def beam_grid_hex(spark, sf_dir):
    return geometry.hex_targets(spark, 128, 0.8, 0.6)


@query(
    "uv_baselines",
    "i long, j long, u d6, v d6",
    """SELECT p.a AS i, q.a AS j, s * (q.x - p.x) * (400e6 / 299792458.0::DOUBLE) AS u, s * (q.y - p.y) * (400e6 / 299792458.0::DOUBLE) AS v
    FROM antennas p JOIN antennas q ON p.a < q.a, (VALUES (1), (-1)) signs(s)""",
)
def uv_baselines(spark, sf_dir):
    zero = F.lit(0.0)  # no negative zeros
    return geometry.baselines(geometry.antennas(spark, 32), 400e6).select("i", "j", (F.col("u") + zero).alias("u"), (F.col("v") + zero).alias("v"))


GAIN_SQL = """
    WITH s AS (SELECT radians(108.0::DOUBLE) / (2 * sqrt(2 * ln(2.0::DOUBLE))) AS se, radians(74.0::DOUBLE) / (2 * sqrt(2 * ln(2.0::DOUBLE))) AS sh),
    p AS (SELECT range AS pixel, (range % 21 - 10) / 10.0::DOUBLE AS l, (range // 21 - 10) / 10.0::DOUBLE AS m FROM range(441)),
    k AS (SELECT *, pi() * 0.6::DOUBLE / 299792458.0::DOUBLE * 400e6 AS k FROM (SELECT b, l AS bl, m AS bm FROM beams), p, s),
    g AS (SELECT b, pixel, l, m, 32 * pow(10.0::DOUBLE, 0.775::DOUBLE) * exp(-(l * l / (2 * sh * sh) + m * m / (2 * se * se)))
        * CASE WHEN abs(sin(k * (l - bl))) < 1e-12 THEN 1.0 ELSE pow(sin(8 * k * (l - bl)) / (8 * sin(k * (l - bl))), 2) END
        * CASE WHEN abs(sin(k * (m - bm))) < 1e-12 THEN 1.0 ELSE pow(sin(4 * k * (m - bm)) / (4 * sin(k * (m - bm))), 2) END AS gain FROM k WHERE l * l + m * m <= 1)
"""


def gains(spark):
    i = F.col("id")
    pixels = spark.range(0, 441, 1, 1).select(i.alias("pixel"), ((i % 21 - 10) / 10.0).alias("l"), ((F.floor(i / 21) - 10) / 10.0).alias("m"))
    return geometry.beam_power(V.beams(spark), pixels, 32, F.lit(400e6))


@query("beam_response", "b long, pixel long, gain d6", GAIN_SQL + "SELECT b, pixel, gain FROM g")
def beam_response(spark, sf_dir):
    return gains(spark).where(~F.isnan("gain"))


@query(
    "beam_coverage",
    "pixel long, overlap long",
    GAIN_SQL + "SELECT pixel, count(*) FILTER (gain >= peak * pow(10.0::DOUBLE, -0.3::DOUBLE)) AS overlap FROM g JOIN (SELECT b, max(gain) AS peak FROM g GROUP BY b) USING (b) GROUP BY pixel",
)
def beam_coverage(spark, sf_dir):
    return geometry.coverage(gains(spark))


#: Antenna widths (degrees) and gain (dBi) at a frequency, on straight lines between and beyond the three anchors.
BAND_SQL = """
    WITH c AS (SELECT 300e6 + range * 12e6 AS hz FROM range(32)),
    s AS (SELECT hz, radians(CASE WHEN hz < 400e6 THEN 92.0::DOUBLE + (hz - 300e6) * (16.0::DOUBLE / 100e6) ELSE 108.0::DOUBLE + (hz - 400e6) * (12.0::DOUBLE / 100e6) END) / (2 * sqrt(2 * ln(2.0::DOUBLE))) AS se,
        radians(CASE WHEN hz < 400e6 THEN 66.0::DOUBLE + (hz - 300e6) * (8.0::DOUBLE / 100e6) ELSE 74.0::DOUBLE + (hz - 400e6) * (13.0::DOUBLE / 100e6) END) / (2 * sqrt(2 * ln(2.0::DOUBLE))) AS sh,
        (CASE WHEN hz < 400e6 THEN 8.7::DOUBLE + (hz - 300e6) * (-0.95::DOUBLE / 100e6) ELSE 7.75::DOUBLE + (hz - 400e6) * (-0.75::DOUBLE / 100e6) END) / 10 AS g10 FROM c),
    p AS (SELECT range AS pixel, (range % 21 - 10) / 10.0::DOUBLE AS l, (range // 21 - 10) / 10.0::DOUBLE AS m FROM range(441)),
    k AS (SELECT *, pi() * 0.6::DOUBLE / 299792458.0::DOUBLE * hz AS k FROM (SELECT b, l AS bl, m AS bm FROM beams), p, s),
    g AS (SELECT b, pixel, hz, 32 * pow(10.0::DOUBLE, g10) * exp(-(l * l / (2 * sh * sh) + m * m / (2 * se * se)))
        * CASE WHEN abs(sin(k * (l - bl))) < 1e-12 THEN 1.0 ELSE pow(sin(8 * k * (l - bl)) / (8 * sin(k * (l - bl))), 2) END
        * CASE WHEN abs(sin(k * (m - bm))) < 1e-12 THEN 1.0 ELSE pow(sin(4 * k * (m - bm)) / (4 * sin(k * (m - bm))), 2) END AS gain FROM k WHERE l * l + m * m <= 1)
    SELECT pixel, 10 * log10(max(mean)) AS gain_dbi FROM (SELECT b, pixel, avg(gain) AS mean FROM g GROUP BY 1, 2) GROUP BY pixel
"""


@query("band_average_gain", "pixel long, gain_dbi d4", BAND_SQL.strip().replace("WITH c AS", ", c AS", 1))
def band_average_gain(spark, sf_dir):
    """Mean over 32 channels from 300 to 672 MHz, beyond the last anchor of the antenna's widths and gain."""
    i = F.col("id")
    pixels = spark.range(0, 441, 1, 1).select(i.alias("pixel"), ((i % 21 - 10) / 10.0).alias("l"), ((F.floor(i / 21) - 10) / 10.0).alias("m"))
    band = geometry.channels(spark, 32, 300e6, 12e6)
    return geometry.band_average(geometry.beam_power(V.beams(spark), pixels.crossJoin(F.broadcast(band)), 32, F.col("hz")))


# --- covariance and search


COVARIANCE_SQL = """SELECT p.t // 64 AS w, p.f AS f, p.a AS r, q.a AS c, sum(p.re * q.re + p.im * q.im) / count(*)::DOUBLE AS re, sum(p.im * q.re - p.re * q.im) / count(*)::DOUBLE + 0.0 AS im
    FROM frame_samples p JOIN frame_samples q ON p.t = q.t AND p.f = q.f GROUP BY 1, 2, 3, 4"""


@query("covariance_relational", "w long, f long, r long, c long, re d6, im d6", COVARIANCE_SQL)
def covariance_relational(spark, sf_dir):
    from beamquarry.sources import tensors

    return doa.covariance_relational(tensors.decoded(V.frames(spark, sf_dir), V.ANTENNAS), FRAME_SPECTRA)


@query("covariance_frames", "w long, f long, r long, c long, re d6, im d6", COVARIANCE_SQL)
def covariance_frames(spark, sf_dir):
    """The same from packed frames, a matrix product for each window and channel, without a join."""
    covs = doa.covariances(V.frames(spark, sf_dir), V.ANTENNAS, FRAME_SPECTRA, kind=np.complex128)
    rows = doa.covariance_rows(covs, np.complex128)
    return rows.select("w", "f", "r", "c", "re", (F.col("im") + F.lit(0.0)).alias("im"))


@query(
    "rls_fold",
    "f long, w long, folded d3",
    """, p AS (SELECT f, t // 320 AS w, CAST(sum(power) AS DOUBLE) AS power FROM sample_power GROUP BY 1, 2),
    o AS (SELECT f, list(w ORDER BY w) AS ws, list(power ORDER BY w) AS ps FROM p GROUP BY f)
    SELECT f, unnest(ws) AS w, unnest(list_transform(range(1, len(ps) + 1), lambda i: list_reduce(ps[1:i], lambda x, y: 0.9::DOUBLE * x + 0.1::DOUBLE * y))) AS folded FROM o""",
)
def rls_fold(spark, sf_dir):
    power = beamform.integrate(V.sample_power(spark, sf_dir), SPECTRA, ("f",))
    return doa.rls_fold(power, "f", "w", "power", 0.9)


@query(
    "rls_blocks",
    "f long, w long, folded d6",
    """, p AS (SELECT f, t // 64 AS w, CAST(sum(power) AS DOUBLE) AS power FROM sample_power GROUP BY 1, 2),
    n AS (SELECT f, w, power, row_number() OVER (PARTITION BY f ORDER BY w) - 1 AS i FROM p)
    SELECT a.f, a.w, sum(pow(0.875::DOUBLE, a.i - b.i) * CASE WHEN b.i = 0 THEN b.power ELSE 0.125::DOUBLE * b.power END) AS folded
    FROM n a JOIN n b ON b.f = a.f AND b.i <= a.i AND a.i - b.i < 400 GROUP BY 1, 2""",
)
def rls_blocks(spark, sf_dir):
    """A fold over many windows in blocks of 32, with a factor that binary numbers hold exactly; terms older than 400 windows are below rounding."""
    power = beamform.integrate(V.sample_power(spark, sf_dir), 64, ("f",))
    return doa.rls_fold(power, "f", "w", "power", 0.875, block=32)


def frame_hz():
    return 300e6 + np.arange(V.FRAME_CHANNELS) * 0.3e6


def searched(spark, sf_dir, config):
    return doa.estimate(doa.observed(V.frames(spark, sf_dir), positions(), config), frame_hz(), positions(), config)


@query("doa_bartlett", "shard_id long, w long, l d6, m d6, n d6, power d3", "SELECT * FROM found")
def doa_bartlett(spark, sf_dir):
    """Coarse grid and two refinements for each window of each observation, around the estimate before, over sums by baseline."""
    return searched(spark, sf_dir, SearchConfig(spectra=FRAME_SPECTRA))


@query("doa_forgetting", "shard_id long, w long, l d6, m d6, n d6, power d3", "SELECT * FROM faded_found")
def doa_forgetting(spark, sf_dir):
    """The same with a memory that loses a tenth a window."""
    return searched(spark, sf_dir, SearchConfig(spectra=FRAME_SPECTRA, forgetting=0.9))


@query("doa_interpolated", "shard_id long, w long, l d6, m d6, n d6, power d3", "SELECT * FROM smooth_found")
def doa_interpolated(spark, sf_dir):
    """The coarse grid alone, and from its peak to the vertex of the parabolas through its neighbours."""
    return searched(spark, sf_dir, SearchConfig(spectra=FRAME_SPECTRA, levels=0, interpolate=True, interpolation="corrected"))


@query(
    "doa_prior",
    "shard_id long, t long, f long, power d4",
    """SELECT shard_id, t, f, pow(sum(cos(p) * re - sin(p) * im), 2) + pow(sum(cos(p) * im + sin(p) * re), 2) AS power FROM
    (SELECT t // 256 AS shard_id, t, f, re, im, 2 * pi() / 299792458.0::DOUBLE * (300e6 + f * 0.3e6) * 0.6::DOUBLE *
    (a % 8 * (0.02::DOUBLE + 64 * (t // 64) * 1e-8::DOUBLE) + a // 8 * (-0.03::DOUBLE + 64 * (t // 64) * -2e-9::DOUBLE)) AS p FROM frame_samples) GROUP BY 1, 2, 3""",
)
def doa_prior(spark, sf_dir):
    """Without a grid there is no search: the beam follows the path that was given."""
    return doa.run(V.frames(spark, sf_dir), frame_hz(), positions(), SearchConfig(spectra=FRAME_SPECTRA, grid=1, prior=STILL))[1]


@query("doa_capon", "shard_id long, w long, l d4, m d4, n d4")
def doa_capon(spark, sf_dir):
    return searched(spark, sf_dir, SearchConfig(spectra=FRAME_SPECTRA, estimator="capon", forgetting=0.9))


@query(
    "doa_emission",
    "shard_id long, t long, f long, power d4",
    """SELECT shard_id, t, f, pow(sum(cos(p) * re - sin(p) * im), 2) + pow(sum(cos(p) * im + sin(p) * re), 2) AS power FROM
    (SELECT shard_id, t, f, re, im, 2 * pi() / 299792458.0::DOUBLE * (300e6 + f * 0.3e6) * 0.6::DOUBLE * (a % 8 * l + a // 8 * m) AS p FROM frame_samples JOIN found ON w = t // 64) GROUP BY 1, 2, 3""",
)
def doa_emission(spark, sf_dir):
    """The beam of each frame at its window's estimate."""
    return doa.run(V.frames(spark, sf_dir), frame_hz(), positions(), SearchConfig(spectra=FRAME_SPECTRA))[1]


@query(
    "capon_grid",
    "w long, cell long, power d4",
    """, x AS (SELECT p.t // 64 AS w, p.f AS f, (avg(p.re * p.re + p.im * p.im) + avg(q.re * q.re + q.im * q.im)) / 2 AS own,
    avg(p.re * q.re + p.im * q.im) AS re, avg(p.im * q.re - p.re * q.im) AS im FROM frame_samples p JOIN frame_samples q ON p.t = q.t AND q.a = p.a + 1 GROUP BY 1, 2),
    d AS (SELECT w, f, own * 1.01::DOUBLE AS d, re, im, 2 * pi() / 299792458.0::DOUBLE * (300e6 + f * 0.3e6) * 0.6::DOUBLE AS k FROM x)
    SELECT w, cell.range AS cell, sum((d * d - re * re - im * im) / (2 * d - 2 * (re * cos(k * l) + im * sin(k * l)))) AS power FROM d, range(9) cell, LATERAL (SELECT -0.4::DOUBLE + cell.range * 0.1::DOUBLE AS l) GROUP BY 1, 2""",
)
def capon_grid(spark, sf_dir):
    """Capon's spectrum over nine cells, of covariances smoothed over sub-arrays of two elements, forward and backward, for which there is a closed form."""
    l_axis = -0.4 + np.arange(9) * 0.1
    look = np.stack([l_axis, 0 * l_axis, np.sqrt(1 - l_axis**2)], axis=1)
    covs = doa.covariances(V.frames(spark, sf_dir), V.ANTENNAS, FRAME_SPECTRA, subarray=2, kind=np.complex128)
    return doa.grid_powers(covs, frame_hz(), positions(), look, "capon", kind=np.complex128)


# --- bursts

TRIALS, TRIAL_DM = 51, 100.0
SHIFT = "CAST(round_even(4148.808::DOUBLE * dm * (pow(hz / 1e6, -2.0) - pow(800.0::DOUBLE, -2.0)) * 952.381::DOUBLE, 0) AS BIGINT)"
SWEEP_SQL = f"""
    , trials AS (SELECT range AS trial, 60.0::DOUBLE + range * (80.0::DOUBLE / 50) AS dm FROM range(51)),
    moved AS (SELECT trial, (((t - {SHIFT}) % 4320) + 4320) % 4320 AS t, power FROM waterfall JOIN burst_channels USING (f), trials),
    profile AS (SELECT trial, t, CAST(sum(power) AS BIGINT) AS power FROM
        (SELECT trial, t, power FROM moved UNION ALL SELECT trial, r.range, 0 FROM trials, range(4320) r) GROUP BY trial, t),
    peaks AS (SELECT trial, arg_min(t, (-power, t)) AS peak_t, max(power) AS peak FROM profile GROUP BY trial),
    base AS (SELECT trial, peak_t, any_value(peak) AS peak, avg(power) FILTER (t < peak_t - 216 OR t >= peak_t + 216) AS baseline_mean,
        stddev_pop(power) FILTER (t < peak_t - 216 OR t >= peak_t + 216) AS baseline_std FROM profile JOIN peaks USING (trial) GROUP BY trial, peak_t),
    snrs AS (SELECT trial, dm, peak_t, baseline_mean, baseline_std, (peak - baseline_mean) / baseline_std AS snr FROM base JOIN trials USING (trial))
"""


@query("dispersion_delays", "f long, hz d3, delay_s d9", "SELECT f, hz, 4148.808::DOUBLE * 100.0::DOUBLE * (pow(hz / 1e6, -2.0) - pow(800.0::DOUBLE, -2.0)) AS delay_s FROM burst_channels")
def dispersion_delays(spark, sf_dir):
    return V.burst_channels(spark).withColumn("delay_s", S.dispersion_delay(F.lit(TRIAL_DM), F.col("hz")))


@query("dedisperse_profile", "trial long, t long, power long", SWEEP_SQL + "SELECT * FROM profile")
def dedisperse_profile(spark, sf_dir):
    """Profiles of all trials."""
    trials = burst.trial_table(spark, TRIAL_DM, TRIALS)
    moved = burst.dedisperse(V.waterfall(spark, sf_dir), burst.shifts(V.burst_channels(spark), trials), V.BINS)
    return burst.profile(moved, V.BINS)


@query("profile_snr", "trial long, peak_t long, baseline_mean d4, baseline_std d4, snr d4", SWEEP_SQL + "SELECT * FROM snrs")
def profile_snr(spark, sf_dir):
    trials = burst.trial_table(spark, TRIAL_DM, TRIALS)
    moved = burst.dedisperse(V.waterfall(spark, sf_dir), burst.shifts(V.burst_channels(spark), trials), V.BINS)
    return burst.profile_snr(burst.profile(moved, V.BINS), V.BINS)


@query("dm_sweep", "trial long, dm d6, peak_t long, snr d4", SWEEP_SQL + "SELECT * FROM snrs")
def dm_sweep(spark, sf_dir):
    return burst.sweep(V.waterfall(spark, sf_dir), V.burst_channels(spark), burst.trial_table(spark, TRIAL_DM, TRIALS), V.BINS)


FINE = 160
FINE_SQL = SWEEP_SQL.replace("60.0::DOUBLE + range * (80.0::DOUBLE / 50)", f"99.0::DOUBLE + range * (2.0::DOUBLE / {FINE - 1})").replace("range(51)", f"range({FINE})")


@query("dm_sweep_fine", "trial long, dm d6, peak_t long, snr d4", FINE_SQL + "SELECT * FROM snrs")
def dm_sweep_fine(spark, sf_dir):
    """Trials closer than a sample's delay: most of their shifts are the same, and so are their partial profiles."""
    return burst.sweep(V.waterfall(spark, sf_dir), V.burst_channels(spark), burst.trial_table(spark, TRIAL_DM, FINE, 0.01), V.BINS)


@query("best_dm", "trial long, dm d6, snr d4", SWEEP_SQL + "SELECT * FROM snrs ORDER BY snr DESC, trial LIMIT 1")
def best_dm(spark, sf_dir):
    return burst.best_trial(burst.sweep(V.waterfall(spark, sf_dir), V.burst_channels(spark), burst.trial_table(spark, TRIAL_DM, TRIALS), V.BINS))


BURST_TIME, BURST_RATE = 16384, 952.381


@query("pulse_fit", "trial long, err_t0_ms d1, err_sigma_ms d1, err_gamma d1, passed boolean")
def pulse_fit(spark, sf_dir):
    """Every catalogued burst, drawn with noise for its own S/N, dedispersed at its own measure and fitted, spectral index included."""
    channels, found = V.burst_channels(spark), []
    for number, shape in enumerate(burst.CATALOG):
        trials = spark.createDataFrame([(number, shape[1])], "trial int, dm double")
        light, shift = kept(burst.synthesize(channels, shape, BURST_TIME), "burst"), burst.shifts(channels, trials)
        top = burst.profile(burst.dedisperse(light, shift, BURST_TIME), BURST_TIME).agg(F.max("power")).first()[0]
        # uniform noise of width u in each of C channels spreads a profile by u sqrt(C / 12)
        level = top / shape[7] * (12 / V.BURST_CHANNELS) ** 0.5
        moved = burst.dedisperse(burst.with_noise(light, level), shift, BURST_TIME)
        profiles = burst.profile(moved, BURST_TIME)
        snrs = burst.profile_snr(profiles, BURST_TIME)
        at = snrs.first()
        index = burst.spectral_index(burst.channel_powers(moved, at["peak_t"], at["baseline_mean"], BURST_TIME, V.BURST_CHANNELS), channels)
        found.append(burst.recovery(burst.fit_profiles(profiles, snrs, shape[3], shape[4]), snrs, shape, index))
    return reduce(DataFrame.unionByName, found)


@query(
    "burst_catalog",
    "name string, dm d2, width_s d6, target_snr d2",
    f"SELECT * FROM (VALUES {', '.join(str((x[0], x[1], x[3], x[7])) for x in burst.CATALOG)}) catalog(name, dm, width_s, target_snr)",
)
def burst_catalog(spark, sf_dir):
    return burst.catalog(spark)


@query(
    "array_scaling_slope",
    "slope d6",
    """SELECT regr_slope(ln(power), ln(n)) AS slope FROM (SELECT n, sum(power) AS power FROM (VALUES (4), (8), (16), (32)) sizes(n) JOIN
    (SELECT a, sum(re * re + im * im)::DOUBLE AS power FROM samples GROUP BY a) s ON a < n GROUP BY n)""",
)
def array_scaling_slope(spark, sf_dir):
    """Slope of log power over the log of how many antennas are summed."""
    by_antenna = V.samples(spark, sf_dir).groupBy("a").agg(F.sum(S.power(F.col("re"), F.col("im"))).alias("power"))  # 32 rows
    sizes = by_antenna.select("power", F.explode(F.filter(F.array(*map(F.lit, (4, 8, 16, 32))), lambda n: F.col("a") < n)).alias("n"))
    return compare.log_slope(sizes.groupBy("n").agg(F.sum("power").cast("double").alias("power")), "n", "power")


# --- comparison


def pairs(spark, sf_dir):
    """Integrated power against itself after the quantizer."""
    codes = quantize.quantize(integrated(spark, sf_dir))
    back = codes.withColumn("back", S.dequantize(F.col("code"), F.col("offset"), F.col("scale")))
    return back.select("w", "f", "b", F.col("power").alias("r"), F.col("back").alias("c"))


@query(
    "compare_metrics",
    "max_absolute_error d4, mean_relative_error d8, p99_relative_error d8, max_relative_error d8, correlation d6, outside_tolerance long, total_values long",
    """SELECT max(abs(c - r)) AS max_absolute_error, avg(rel) AS mean_relative_error, quantile_cont(rel, 0.99) AS p99_relative_error, max(rel) AS max_relative_error,
    corr(r, c) AS correlation, count(*) FILTER (abs(c - r) > 10 AND (rel IS NULL OR rel > 0.01)) AS outside_tolerance, count(*) AS total_values
    FROM (SELECT r, c, CASE WHEN abs(r) > 10 THEN abs(c - r) / abs(r) END AS rel FROM pairs)""",
)
def compare_metrics(spark, sf_dir):
    return compare.metrics(pairs(spark, sf_dir), 10.0, 0.01)


@query(
    "output_stats",
    "max_absolute_error d4, mean_absolute_error d4, p99_relative_error d8, output_count long, outside_tolerance long, correlation d6, nrmse d8",
    """SELECT max(abs(c - r)) AS max_absolute_error, avg(abs(c - r)) AS mean_absolute_error, quantile_disc(rel, 0.99) AS p99_relative_error, count(*) AS output_count,
    count(*) FILTER (abs(c - r) > 10 + 0.01::DOUBLE * abs(r)) AS outside_tolerance, corr(r, c) AS correlation, sqrt(sum((c - r) * (c - r)) / sum(r * r)) AS nrmse
    FROM (SELECT r, c, CASE WHEN abs(r) > 10 THEN abs(c - r) / abs(r) END AS rel FROM pairs)""",
)
def output_stats(spark, sf_dir):
    return compare.output_stats(pairs(spark, sf_dir), 10.0, 0.01)


@query(
    "diff_stats",
    "max_abs_diff d4, rms_diff d4, max_rel_error d8, passed_tolerance boolean, rel_error d8",
    """SELECT max(abs(c - r)) AS max_abs_diff, sqrt(avg((c - r) * (c - r))) AS rms_diff, max(abs(c - r) / greatest(abs(r), 1e-5)) AS max_rel_error,
    bool_and(NOT (abs(c - r) > 1e-5 AND abs(c - r) > 1e-4 * r)) AS passed_tolerance, sqrt(avg((c - r) * (c - r))) / sqrt(avg(r * r)) AS rel_error FROM pairs""",
)
def diff_stats(spark, sf_dir):
    return compare.difference_stats(pairs(spark, sf_dir))


@query(
    "window_stats",
    "w long, mean_power d3, max_abs_diff d4, rms_diff d4",
    "SELECT w, avg(c) AS mean_power, max(abs(c - r)) AS max_abs_diff, sqrt(avg((c - r) * (c - r))) AS rms_diff FROM pairs GROUP BY w",
)
def window_stats(spark, sf_dir):
    return compare.window_stats(pairs(spark, sf_dir), ["w"])


@query(
    "reference_unmatched",
    "unmatched long",
    "SELECT count(*) AS unmatched FROM sample_power WHERE t % 7 = 0 OR f % 5 = 0",
)
def reference_unmatched(spark, sf_dir):
    """A full join of two cubes with different holes; what only one has is counted, never dropped."""
    power = V.sample_power(spark, sf_dir)
    left, right = power.where("t % 7 <> 0"), power.where("f % 5 <> 0 OR t % 7 = 0")
    gone = compare.unmatched(compare.paired(left, right, ["t", "f"]))
    return gone


@query(
    "latency_summary",
    "engine string, kernel string, min_ms d4, mean_ms d4, median_ms d4, p95_ms d4, max_ms d4",
    """SELECT engine, kernel, min(latency_ms) AS min_ms, avg(latency_ms) AS mean_ms, median(latency_ms) AS median_ms,
    quantile_disc(latency_ms, 0.95) AS p95_ms, max(latency_ms) AS max_ms FROM latencies GROUP BY 1, 2""",
)
def latency_summary(spark, sf_dir):
    return compare.latency_summary(V.latencies(spark, sf_dir), ["engine", "kernel"])


@query(
    "engine_ratios",
    "engine string, min_ms d4, median_ms d4, p95_ms d4, max_ms d4, speedup_vs_a d6",
    """, e AS (SELECT engine, min(latency_ms) AS min_ms, median(latency_ms) AS median_ms, quantile_cont(latency_ms, 0.95) AS p95_ms, max(latency_ms) AS max_ms FROM latencies GROUP BY 1)
    SELECT e.*, CASE WHEN e.engine <> 'A' THEN a.median_ms / e.median_ms END AS speedup_vs_a FROM e, e a WHERE a.engine = 'A'""",
)
def engine_ratios(spark, sf_dir):
    return compare.engine_ratios(V.latencies(spark, sf_dir), {"a": "A"})


@query(
    "timing_groups",
    "n_ant long, n_beams long, repetitions long, cpu_ms_median d4, cpu_ms_p25 d4, cpu_ms_p75 d4, speedup_kernel d6, gpu_kernel_cmac_per_s d2",
    """, g AS (SELECT n_ant, n_beams, count(*) AS repetitions, any_value(n_cmac) AS n_cmac, median(cpu_ms) AS cpu_ms_median, quantile_cont(cpu_ms, 0.25) AS cpu_ms_p25,
    quantile_cont(cpu_ms, 0.75) AS cpu_ms_p75, median(gpu_kernel_ms) AS k FROM timings GROUP BY 1, 2)
    SELECT *, cpu_ms_median / k AS speedup_kernel, n_cmac * 1000.0::DOUBLE / k AS gpu_kernel_cmac_per_s FROM g""",
)
def timing_groups(spark, sf_dir):
    return compare.timing_groups(V.timings(spark, sf_dir), ["cpu_ms", "gpu_kernel_ms", "gpu_pipeline_wall_ms"])


@query(
    "rates",
    "n_ant long, n_beams long, outputs_per_s d2, flop_per_s d2",
    """SELECT n_ant, n_beams, outputs / seconds AS outputs_per_s, (8 * outputs * n_ant + 3 * outputs) / seconds AS flop_per_s FROM
    (SELECT n_ant, n_beams, sum(n_outputs)::DOUBLE AS outputs, sum(CAST(gpu_kernel_ms AS BIGINT))::DOUBLE AS seconds FROM timings GROUP BY 1, 2)""",
)
def rates(spark, sf_dir):
    sums = V.timings(spark, sf_dir).groupBy("n_ant", "n_beams").agg(F.sum("n_outputs").cast("double").alias("outputs"), F.sum(F.col("gpu_kernel_ms").cast("long")).cast("double").alias("seconds"))
    found = S.rates(F.col("outputs"), F.col("n_ant"), F.col("seconds"))
    return sums.select("n_ant", "n_beams", *[v.alias(k) for k, v in found.items()])


@query(
    "beam_time_pivot",
    "n_beams long, 15360 d4",
    "SELECT n_beams, arg_max(l, repeat) AS \"15360\" FROM (SELECT n_beams, repeat, max(cpu_ms) AS l FROM timings WHERE n_ant = 64 GROUP BY 1, 2) GROUP BY n_beams",
)
def beam_time_pivot(spark, sf_dir):
    best = V.timings(spark, sf_dir).groupBy("n_ant", "n_beams", "n_time", "repeat").agg(F.max("cpu_ms").alias("cpu_ms"))
    return compare.beam_time_matrix(best, 64, "cpu_ms", [V.CUBE_TIME])


@query("positive_limits", "lower d4, upper d4", "SELECT min(latency_ms) AS lower, max(latency_ms) AS upper FROM latencies WHERE latency_ms > 0")
def positive_limits(spark, sf_dir):
    return compare.positive_limits(V.latencies(spark, sf_dir), "latency_ms")


@query(
    "direction_errors",
    "mean_prior_error d9, mean_error d9, mean_error_arcmin d6",
    """SELECT avg(sqrt(pow(l - lp, 2) + pow(m - mp, 2))) AS mean_prior_error, avg(sqrt(pow(l - le, 2) + pow(m - me, 2))) AS mean_error,
    avg(degrees(sqrt(pow(l - le, 2) + pow(m - me, 2))) * 60) AS mean_error_arcmin FROM
    (SELECT (vec_id % 100) / 1000.0::DOUBLE AS l, (vec_id % 37) / 1000.0::DOUBLE AS m, (vec_id % 99) / 1000.0::DOUBLE AS le, (vec_id % 36) / 1000.0::DOUBLE AS me,
    (vec_id % 90) / 1000.0::DOUBLE AS lp, (vec_id % 31) / 1000.0::DOUBLE AS mp FROM embeddings)""",
)
def direction_errors(spark, sf_dir):
    k = F.col("vec_id")
    looks = V.table(spark, sf_dir, "embeddings").select(
        *[((k % n) / 1000.0).alias(c) for c, n in (("l", 100), ("m", 37), ("l_est", 99), ("m_est", 36), ("l_prior", 90), ("m_prior", 31))]
    )
    return compare.direction_errors(looks)


# --- streams


@query(
    "stream_tumbling",
    "w long, f long, power long",
    """SELECT t // 320 AS w, f, sum(power) AS power FROM (SELECT t, f, re * re + im * im AS power FROM samples)
    WHERE (t // 320 + 1) * 320 <= (SELECT max(t) FROM samples) GROUP BY 1, 2""",
)
def stream_tumbling(spark, sf_dir):
    """Windows that the stream has closed: those that end no later than the newest sample.

    Line items are one batch or are in order of their keys, so the watermark needs no delay.
    """
    path = f"{sf_dir}/lineitem.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(path if is_folder(spark, path) else f"{sf_dir}/lineitem.parque[t]")
    line = read.select(
        F.col("l_orderkey").alias("t"),
        (F.col("l_suppkey") % V.CHANNELS).cast("int").alias("f"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % 256).cast("int").alias("byte"),
    )
    power = line.select("t", "f", S.power(S.unpack_re(F.col("byte")), S.unpack_im(F.col("byte"))).alias("power"))
    return streamed(windows.tumbling(power, SPECTRA, ("f",)))


def is_folder(spark, path):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()


def streamed(stream):
    """Run a stream over what is there, into a table of the shared folder."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_tracker_state", "shard_id long, w long, l d6, m d6, n d6, power d3", "SELECT * FROM faded_found")
def stream_tracker_state(spark, sf_dir):
    """Windows as a stream in three micro-batches; each observation's memory and estimate last from batch to batch."""
    config, path = SearchConfig(spectra=FRAME_SPECTRA, forgetting=0.9), scratch_path(spark, "lags")
    lags = kept(doa.observed(V.frames(spark, sf_dir), positions(), config), "lags")
    for k in range(3):
        lags.where((F.col("w") % 4 == k) if k < 2 else (F.col("w") % 4 >= 2)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(lags.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with windows.keyed_state(spark):
        return streamed(windows.tracked(stream, frame_hz(), positions(), config))


from beamquarry.plans import products  # noqa: E402,F401  registers its queries here
