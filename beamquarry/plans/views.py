"""Sensor-array views of the driver's tables, in Spark and in SQL text that makes the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.operators import geometry

CHANNELS, ANTENNAS, CUBE_TIME, FRAME_CHANNELS = 32, 32, 15360, 16
#: Vectors of one observation, which is searched by itself: four windows of 64 frames.
OBSERVATION = 256
#: The burst views: ten-minute bins of 30 days, 16 channels from 400 MHz in steps of 25 MHz.
BIN_S, BINS, BURST_CHANNELS, BURST_START_HZ, BURST_STEP_HZ = 600, 4320, 16, 400e6, 25e6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, f, a, byte): one packed sample for each line item; a place may have several, which add up."""
    key, part, supplier, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        key.alias("t"),
        (supplier % CHANNELS).cast("int").alias("f"),
        (part % ANTENNAS).cast("int").alias("a"),
        ((part * 31 + supplier * 17 + line) % 256).cast("int").alias("byte"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.col("byte")
    return voltage(spark, sf_dir).select("t", "f", "a", S.unpack_re(byte).alias("re"), S.unpack_im(byte).alias("im"))


def cube_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all cubes laid over each other, so that a path stays in the disk however many there are."""
    return samples(spark, sf_dir).withColumn("t", F.col("t") % CUBE_TIME)


def sample_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, f, power): integer power of all samples of a place."""
    return samples(spark, sf_dir).groupBy("t", "f").agg(F.sum(S.power(F.col("re"), F.col("im"))).alias("power"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard_id, t, f, payload): a frame for each vector, elements 0 to 31 real, 32 to 63 imaginary, in sixteenths; a shard is an observation."""
    x = F.col("embedding").cast("array<double>")

    def scaled(i: Column) -> Column:
        return S.pack_clipped(F.get(x, i) * 16, F.get(x, i + ANTENNAS) * 16)

    payload = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(ANTENNAS - 1)), lambda i: F.lpad(F.hex(scaled(i).cast("long")), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / OBSERVATION).cast("int").alias("shard_id"), F.col("vec_id").alias("t"), (F.col("vec_id") % FRAME_CHANNELS).cast("int").alias("f"), payload.alias("payload"))


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, f, power): cents of each ten-minute bin and group of users."""
    t = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BIN_S * 1_000_000)).cast("long"), F.lit(BINS))
    power = F.sum(F.rint(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(t.alias("t"), (F.col("user_id") % BURST_CHANNELS).cast("int").alias("f")).agg(power.alias("power"))


def integer_weights(spark: SparkSession, beams: int, channels: int = CHANNELS) -> DataFrame:
    """(b, f, a, wr, wi) of -1, 0 and 1, with which sums are exact in any order and precision."""
    k = F.col("id")
    b, f, a = F.floor(k / (channels * ANTENNAS)), F.floor(k / ANTENNAS) % channels, k % ANTENNAS
    rows = spark.range(0, beams * channels * ANTENNAS, 1, 1).select(b.cast("int").alias("b"), f.cast("int").alias("f"), a.cast("int").alias("a"))
    b, f, a = F.col("b"), F.col("f"), F.col("a")
    return rows.select("b", "f", "a", ((a * 3 + b * 5 + f) % 3 - 1).alias("wr"), ((a * 7 + b * 2 + f * 2) % 3 - 1).alias("wi"))


def beams(spark: SparkSession, count: int = 4) -> DataFrame:
    return geometry.line_beams(spark, count)


def burst_channels(spark: SparkSession) -> DataFrame:
    return geometry.channels(spark, BURST_CHANNELS, BURST_START_HZ, BURST_STEP_HZ)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing records: a line item's price, quantity and tax as milliseconds of a problem size."""
    line = F.col("l_linenumber")
    n_ant, n_beams = F.expr("shiftleft(32, l_linenumber % 3)"), line % 4 + 1
    return table(spark, sf_dir, "lineitem").select(
        n_ant.alias("n_ant"),
        F.lit(336).alias("n_freq"),
        n_beams.alias("n_beams"),
        F.lit(CUBE_TIME).alias("n_time"),
        F.col("l_orderkey").alias("repeat"),
        (n_beams * 336 * CUBE_TIME).cast("long").alias("n_outputs"),
        (n_beams * 336 * n_ant).cast("long").alias("n_cmac"),
        (n_beams * 8.0).alias("estimated_flop"),
        F.col("l_extendedprice").alias("cpu_ms"),
        F.col("l_quantity").alias("gpu_kernel_ms"),
        (F.col("l_tax") + 1).alias("gpu_pipeline_wall_ms"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("kernel"), F.col("l_extendedprice").alias("latency_ms"))


#: The same views for DuckDB, to be put before a query.
SQL = {
    "voltage": f"""SELECT l_orderkey AS t, l_suppkey % {CHANNELS} AS f, l_partkey % {ANTENNAS} AS a,
        (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 256 AS byte FROM lineitem""",
    "samples": """SELECT t, f, a, (((byte & 15) + 8) % 16) - 8 AS re, (((byte >> 4) + 8) % 16) - 8 AS im FROM voltage""",
    "cube_samples": f"SELECT t % {CUBE_TIME} AS t, f, a, re, im FROM samples",
    "sample_power": "SELECT t, f, CAST(sum(re * re + im * im) AS BIGINT) AS power FROM samples GROUP BY t, f",
    "antennas": "SELECT range AS a, (range % 8) * 0.6::DOUBLE AS x, (range // 8) * 0.6::DOUBLE AS y, 0.0::DOUBLE AS z FROM range(32)",
    "channels": f"SELECT range AS f, 300e6 + range * 0.3e6 AS hz FROM range({CHANNELS})",
    "beams": "SELECT range AS b, (range - 2) * 0.02::DOUBLE AS l, 0.0::DOUBLE AS m, sqrt(1.0 - pow((range - 2) * 0.02::DOUBLE, 2)) AS n FROM range(4)",
    "weights": """SELECT b, f, a, cos(phi) AS wr, sin(phi) AS wi FROM
        (SELECT b, f, a, 2 * pi() / 299792458.0::DOUBLE * hz * (x * l + y * m + z * n) AS phi FROM beams, channels, antennas)""",
    "intensity": """SELECT t, f, b, sr * sr + si * si AS power FROM
        (SELECT t, f, b, sum(wr * re - wi * im) AS sr, sum(wr * im + wi * re) AS si FROM samples JOIN weights USING (f, a) GROUP BY t, f, b)""",
    "integer_weights": f"""SELECT b.range AS b, f.range AS f, a.range AS a, (a.range * 3 + b.range * 5 + f.range) % 3 - 1 AS wr,
        (a.range * 7 + b.range * 2 + f.range * 2) % 3 - 1 AS wi FROM range(8) b, range({CHANNELS}) f, range({ANTENNAS}) a""",
    "integer_power": """SELECT t, f, b, CAST(sr * sr + si * si AS BIGINT) AS power FROM
        (SELECT t, f, b, sum(wr * re - wi * im) AS sr, sum(wr * im + wi * re) AS si FROM samples JOIN integer_weights USING (f, a) GROUP BY t, f, b)""",
    "integrated": "SELECT t // 320 AS w, f, b, CAST(sum(power) AS DOUBLE) AS power FROM integer_power GROUP BY 1, 2, 3",
    "tile_range": "SELECT w, f // 16 AS ft, b // 16 AS bt, min(power) AS low, max(power) AS high FROM integrated GROUP BY 1, 2, 3",
    "tiles": """SELECT w, ft, bt, CASE WHEN low = high THEN low ELSE low + 127.5::DOUBLE * ((high - low) / 255.0::DOUBLE) END AS "offset",
        (high - low) / 255.0::DOUBLE AS scale FROM tile_range""",
    "codes": """SELECT i.w, f, b, power, "offset", scale, CASE WHEN scale = 0 THEN 0
        ELSE greatest(-127, least(127, round_even((power - "offset") / scale, 0))) END AS code
        FROM integrated i JOIN tiles p ON i.w = p.w AND i.f // 16 = p.ft AND i.b // 16 = p.bt""",
    "pairs": 'SELECT w, f, b, power AS r, "offset" + scale * code AS c FROM codes',
    "frame_samples": f"""SELECT vec_id AS t, vec_id % {FRAME_CHANNELS} AS f, a.range AS a,
        greatest(-7, least(7, round_even(embedding[a.range + 1]::DOUBLE * 16, 0))) AS re,
        greatest(-7, least(7, round_even(embedding[a.range + 33]::DOUBLE * 16, 0))) AS im FROM embeddings, range({ANTENNAS}) a""",
    "frame_power": """SELECT t, f, b, CAST(sr * sr + si * si AS BIGINT) AS power FROM
        (SELECT t, f, b, sum(wr * re - wi * im) AS sr, sum(wr * im + wi * re) AS si FROM frame_samples JOIN integer_weights USING (f, a) GROUP BY t, f, b)""",
    "window_lags": """SELECT w, f, dx, dy, sum(re) / any_value(k) AS re, sum(im) / any_value(k) AS im FROM
        (SELECT p.t // 64 AS w, p.f AS f, p.a % 8 - q.a % 8 AS dx, p.a // 8 - q.a // 8 AS dy, sum(p.re * q.re + p.im * q.im) AS re, sum(p.im * q.re - p.re * q.im) AS im
        FROM frame_samples p JOIN frame_samples q ON p.t = q.t GROUP BY 1, 2, 3, 4)
        JOIN (SELECT vec_id // 64 AS w, vec_id % 16 AS f, count(*)::DOUBLE AS k FROM embeddings GROUP BY 1, 2) USING (w, f) GROUP BY w, f, dx, dy""",
    "kept_lags": "SELECT w, f, dx, dy, re, im, w // 4 AS shard_id FROM window_lags",
    "faded_lags": """SELECT n.w, n.f, n.dx, n.dy, n.w // 4 AS shard_id, sum(o.re * weight) AS re, sum(o.im * weight) AS im FROM (SELECT w, f, dx, dy FROM window_lags) n
        JOIN (SELECT * FROM window_lags) o ON o.f = n.f AND o.dx = n.dx AND o.dy = n.dy AND o.w // 4 = n.w // 4 AND o.w <= n.w,
        LATERAL (SELECT CASE WHEN o.w % 4 = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, n.w - o.w) AS weight) GROUP BY 1, 2, 3, 4""",
    **{
        walk: f"""SELECT w // 4 AS shard_id, min(w) AS w, 0 AS stage, 0.0::DOUBLE AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS power FROM (SELECT vec_id // 64 AS w FROM embeddings) GROUP BY 1
        UNION ALL SELECT shard_id, CASE WHEN stage = 2 THEN w + 1 ELSE w END, (stage + 1) % 3, best.l, best.m, best.power FROM
        (SELECT shard_id, w, stage, arg_max({{'l': l, 'm': m, 'power': power}}, power) AS best FROM
        (SELECT c.shard_id, c.w, stage, cell, l, m, sum(re * cos(k * (dx * l + dy * m)) - im * sin(k * (dx * l + dy * m))) AS power FROM
        (SELECT shard_id, w, stage, cell, x * pull AS l, y * pull AS m FROM
        (SELECT *, CASE WHEN x * x + y * y > 0.999 THEN sqrt(0.999::DOUBLE / (x * x + y * y)) ELSE 1.0::DOUBLE END AS pull FROM
        (SELECT shard_id, w, stage, cell.range AS cell, CASE WHEN stage = 0 THEN l - 0.2::DOUBLE + (cell.range % 16) * (0.4::DOUBLE / 15) ELSE l + (cell.range % 3 - 1) * (0.0125::DOUBLE / pow(2, stage)) END AS x,
        CASE WHEN stage = 0 THEN m - 0.2::DOUBLE + (cell.range // 16) * (0.4::DOUBLE / 15) ELSE m + (cell.range // 3 - 1) * (0.0125::DOUBLE / pow(2, stage)) END AS y
        FROM {walk}, range(256) cell WHERE stage = 0 OR cell.range < 9))) c
        JOIN (SELECT *, 2 * pi() / 299792458.0::DOUBLE * (300e6 + f * 0.3e6) * 0.6::DOUBLE AS k FROM {lags}) s ON s.shard_id = c.shard_id AND s.w = c.w GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3)"""
        for walk, lags in (("walk", "kept_lags"), ("faded_walk", "faded_lags"))
    },
    "smooth_walk": """SELECT w // 4 AS shard_id, min(w) AS w, 0.0::DOUBLE AS l, 0.0::DOUBLE AS m, 0.0::DOUBLE AS power FROM (SELECT vec_id // 64 AS w FROM embeddings) GROUP BY 1
        UNION ALL SELECT shard_id, w + 1, x * pull, y * pull, peak FROM
        (SELECT *, CASE WHEN x * x + y * y > 0.999 THEN sqrt(0.999::DOUBLE / (x * x + y * y)) ELSE 1.0::DOUBLE END AS pull FROM
        (SELECT shard_id, w, peak, l + (0.4::DOUBLE / 15) * CASE WHEN a - 2 * peak + b >= 0 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (b - a) / abs(a - 2 * peak + b))) END AS x,
        m + (0.4::DOUBLE / 15) * CASE WHEN c - 2 * peak + d >= 0 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (d - c) / abs(c - 2 * peak + d))) END AS y FROM
        (SELECT shard_id, w, ls[k + 1] AS l, ms[k + 1] AS m, p[k + 1] AS peak, CASE WHEN k % 16 > 0 THEN p[k] ELSE 0 END AS a, CASE WHEN k % 16 < 15 THEN p[k + 2] ELSE 0 END AS b,
        CASE WHEN k >= 16 THEN p[k - 15] ELSE 0 END AS c, CASE WHEN k < 240 THEN p[k + 17] ELSE 0 END AS d FROM
        (SELECT *, list_position(p, list_max(p)) - 1 AS k FROM
        (SELECT shard_id, w, list(l ORDER BY cell) AS ls, list(m ORDER BY cell) AS ms, list(power ORDER BY cell) AS p FROM
        (SELECT c.shard_id, c.w, cell, l, m, sum(re * cos(k * (dx * l + dy * m)) - im * sin(k * (dx * l + dy * m))) AS power FROM
        (SELECT shard_id, w, cell, x * pull AS l, y * pull AS m FROM
        (SELECT *, CASE WHEN x * x + y * y > 0.999 THEN sqrt(0.999::DOUBLE / (x * x + y * y)) ELSE 1.0::DOUBLE END AS pull FROM
        (SELECT shard_id, w, cell.range AS cell, l - 0.2::DOUBLE + (cell.range % 16) * (0.4::DOUBLE / 15) AS x, m - 0.2::DOUBLE + (cell.range // 16) * (0.4::DOUBLE / 15) AS y FROM smooth_walk, range(256) cell))) c
        JOIN (SELECT *, 2 * pi() / 299792458.0::DOUBLE * (300e6 + f * 0.3e6) * 0.6::DOUBLE AS k FROM kept_lags) s ON s.shard_id = c.shard_id AND s.w = c.w GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2)))))""",
    "smooth_found": "SELECT shard_id, w - 1 AS w, l, m, sqrt(1 - l * l - m * m) AS n, power FROM smooth_walk WHERE power <> 0",
    "found": "SELECT shard_id, w - 1 AS w, l, m, sqrt(1 - l * l - m * m) AS n, power FROM walk WHERE stage = 0 AND power <> 0",
    "faded_found": "SELECT shard_id, w - 1 AS w, l, m, sqrt(1 - l * l - m * m) AS n, power FROM faded_walk WHERE stage = 0 AND power <> 0",
    "waterfall": f"""SELECT (epoch_us(ts) // {BIN_S * 1_000_000}) % {BINS} AS t, user_id % {BURST_CHANNELS} AS f,
        CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS power FROM events GROUP BY 1, 2""",
    "burst_channels": f"SELECT range AS f, {BURST_START_HZ} + range * {BURST_STEP_HZ} AS hz FROM range({BURST_CHANNELS})",
    "latencies": "SELECT l_returnflag AS engine, l_linestatus AS kernel, l_extendedprice AS latency_ms FROM lineitem",
    "timings": f"""SELECT 32 << (l_linenumber % 3) AS n_ant, 336 AS n_freq, l_linenumber % 4 + 1 AS n_beams, {CUBE_TIME} AS n_time, l_orderkey AS repeat,
        (l_linenumber % 4 + 1) * 336 * {CUBE_TIME} AS n_outputs, (l_linenumber % 4 + 1) * 336 * (32 << (l_linenumber % 3)) AS n_cmac,
        (l_linenumber % 4 + 1) * 8.0 AS estimated_flop, l_extendedprice AS cpu_ms, l_quantity AS gpu_kernel_ms, l_tax + 1 AS gpu_pipeline_wall_ms FROM lineitem""",
}


def needed(body: str) -> list[str]:
    """The views that a query names, and those that they name, in the order in which they are written."""
    found, left = set(), [body]
    while left:
        words = set(re.findall(r"\w+", left.pop()))
        new = [k for k in SQL if k in words and k not in found]
        found.update(new)
        left += [SQL[k] for k in new]
    return [k for k in SQL if k in found]


def sql(columns: str, body: str) -> str:
    """A query over the views with its columns cast and rounded as `shaped` does for Spark."""
    heads = []
    for name, kind in (c.split() for c in columns.split(", ")):
        if kind[0] == "d" and kind != "double":
            heads.append(f'round(CAST("{name}" AS DOUBLE), {kind[1:]}) AS "{name}"')
        else:
            kinds = {"long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
            heads.append(f'CAST("{name}" AS {kinds[kind]}) AS "{name}"')
    views = ", ".join(f"{k} AS ({SQL[k]})" for k in needed(body))
    body = f"WITH {body.strip()[1:]}" if body.strip().startswith(",") else body
    with_ = "WITH RECURSIVE" if "walk" in views else "WITH"
    return f"{with_} {views}{', ' if views else ''}answer AS ({body}) SELECT {', '.join(heads)} FROM answer"


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """Columns by `name kind`; kind dN is a double rounded to N places."""
    out = []
    for name, kind in (c.split() for c in columns.split(", ")):
        x = F.col(f"`{name}`")
        out.append((F.round(x.cast("double"), int(kind[1:])) if kind[0] == "d" and kind != "double" else x.cast(kind)).alias(name))
    return df.select(*out)
