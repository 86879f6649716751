"""Array queries against DuckDB, and operators against values worked out by hand."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from beamquarry.functions import scalars as S
from beamquarry.model import Dimensions, SearchConfig, Trajectory, integrated_count, window_count
from beamquarry.operators import beamform, burst, compare, doa, geometry, quantize, tracker
from beamquarry.plans import catalog, views
from beamquarry.sources import synthetic, tensors


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_all_int4_values_pack_and_unpack(spark):
    codes = [(r, i) for r in range(-8, 8) for i in range(-8, 8)]
    df = spark.createDataFrame(codes, "re int, im int").withColumn("byte", S.pack(F.col("re"), F.col("im")))
    back = df.select("re", "im", S.unpack_re(F.col("byte")).alias("r"), S.unpack_im(F.col("byte")).alias("i"))
    assert back.where("re <> r OR im <> i").count() == 0
    with pytest.raises(Exception, match="int4"):
        spark.createDataFrame([(8, 0)], "re int, im int").select(S.pack(F.col("re"), F.col("im"))).collect()


def test_window_counts():
    assert [window_count(n, 320) for n in (0, 1, 320, 321, 640, 641)] == [0, 1, 1, 2, 2, 3]
    assert integrated_count(480, 10) == 48
    with pytest.raises(ValueError):
        integrated_count(0, 320)
    with pytest.raises(ValueError):
        Trajectory(0.9, 0, 0.01).check(20, 1)


def test_one_hot_and_constant_sources(spark):
    dims = Dimensions(1, 4, 32, 1)
    zenith = spark.createDataFrame([(0, 0.0, 0.0, 1.0)], "b int, l double, m double, n double")
    weights = beamform.steering_weights(zenith, geometry.channels(spark, 4), geometry.antennas(spark, 32))
    hot = beamform.beamform_packed(synthetic.one_hot(spark, dims, 0, 2, 0, 3, 4), weights)
    assert {r["f"]: round(r["power"], 6) for r in hot.collect()} == {0: 0, 1: 0, 2: 25, 3: 0}
    ones = beamform.beamform_packed(synthetic.constant(spark, dims, 1, 0), weights)
    assert {round(r["power"], 6) for r in ones.collect()} == {1024}


def test_beam_on_the_source_is_the_peak(spark):
    antennas, channels = geometry.antennas(spark, 32), geometry.channels(spark, 4)
    beams = geometry.rectangular_beams(spark, 32)
    at = beams.where("b = 12").collect()[0]
    source = synthetic.point_source(spark, 2, channels, antennas, at["l"], at["m"], 5.0)
    assert compare.peak_beam(beamform.beamform_packed(source, beamform.steering_weights(beams, channels, antennas))).collect()[0]["b"] == 12


def test_frame_form_equals_relational_form(spark):
    dims = Dimensions(6, 3, 32, 5)
    voltage = synthetic.noise(spark, dims, 7)
    antennas, channels = geometry.antennas(spark, 32), geometry.channels(spark, 3)
    weights = beamform.steering_weights(geometry.line_beams(spark, 5), channels, antennas)
    cube = beamform.weight_cube(weights, 5, 3, 32)
    frames = beamform.to_frames(voltage, 32)
    rows = beamform.frame_power(frames, cube).select("t", "f", F.posexplode("power").alias("b", "power")).collect()
    want = {(r["t"], r["f"], r["b"]): r["power"] for r in beamform.beamform_packed(voltage, weights).collect()}
    assert len(rows) == len(want) == 90
    assert all(abs(r["power"] - want[r["t"], r["f"], r["b"]]) <= 1e-2 + 1e-4 * want[r["t"], r["f"], r["b"]] for r in rows)
    path = Trajectory(0.02, -0.03, 1e-4, -2e-4)
    slow = tracker.track_packed(voltage, tracker.all_windows(spark, path, 2, 6), channels, antennas, 2)
    hz, at = [300e6, 300.3e6, 300.6e6], catalog.positions()
    fast = {(r["t"], r["f"]): r["power"] for r in tracker.track_frames(frames, path, hz, at, 2).collect()}
    assert all(abs(fast[r["t"], r["f"]] - r["power"]) <= 1e-2 + 1e-4 * r["power"] for r in slow.collect())


def test_quantizer_tiles(spark):
    rows = spark.range(2 * 336 * 17).selectExpr("id div 5712 AS w", "cast(id div 17 % 336 as int) AS f", "cast(id % 17 as int) AS b")
    values = rows.withColumn("power", F.col("w") * 1000.0 + F.col("f") * 10 + F.col("b"))
    assert quantize.tile_parameters(values).count() == 84
    codes = {(r["w"], r["f"], r["b"]): r["code"] for r in quantize.quantize(values).where("w = 0 AND f IN (0, 15)").collect()}
    assert codes[0, 0, 0] == codes[0, 0, 16] == -127 and codes[0, 15, 15] == codes[0, 15, 16] == 127
    odd = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 1, 0, 3.0), (1, 0, 0, 42.0)], "w long, f int, b int, power double")
    got = {(r["w"], r["f"]): (r["code"], r["offset"], r["scale"]) for r in quantize.quantize(odd).collect()}
    assert got == {(0, 0): (-128, 0, 0), (0, 1): (0, 0, 0), (1, 0): (0, 42, 0)}


def test_fold_beyond_the_range_of_powers(spark):
    n, keep = 3000, 0.5
    rows = spark.range(n).selectExpr("0 AS k", "id AS w", "cast(id % 17 as double) AS v")
    want, r = [], None
    for w in range(n):
        r = float(w % 17) if r is None else keep * r + (1 - keep) * (w % 17)
        want.append(r)
    got = [x["folded"] for x in doa.rls_fold(rows, "k", "w", "v", keep).orderBy("w").collect()]
    assert np.allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("config", [SearchConfig(spectra=4), SearchConfig(spectra=4, estimator="capon"), SearchConfig(spectra=4, subarray=24, levels=1)])
def test_search_finds_the_source(spark, config):
    antennas, channels = geometry.antennas(spark, 32), geometry.channels(spark, 8)
    true = (0.03, 0.01)
    frames = beamform.to_frames(synthetic.point_source(spark, 4, channels, antennas, *true, 4.0), 32).withColumn("shard_id", F.lit(0))
    found, _ = doa.run(frames, 300e6 + np.arange(8) * 0.3e6, catalog.positions(), config)
    row = found.collect()[0]
    assert np.hypot(row["l"] - true[0], row["m"] - true[1]) < np.hypot(*true)


def test_sweep_finds_an_off_grid_measure(spark):
    channels = geometry.channels(spark, 16, 400e6, 25e6)
    shape = ("x", 31.0, 1.0, 0.003, 0.0, 0.0, 0.0, 10.0)
    noisy = burst.with_noise(burst.synthesize(channels, shape, 4096), 0.1)
    swept = burst.sweep(noisy, channels, burst.trial_table(spark, 30.0, 13), 4096)
    assert abs(burst.best_trial(swept).collect()[0]["dm"] - 31.0) <= 2.0


def test_files_round_trip(spark, tmp_path):
    dims = Dimensions(3, 2, 32, 1)
    raw = np.random.default_rng(1).integers(0, 256, 192).astype(np.uint8)
    (tmp_path / "v.bin").write_bytes(raw.tobytes())
    rows = tensors.read_packed_voltage(spark, str(tmp_path / "v.bin"), dims).orderBy("t", "f").collect()
    assert b"".join(bytes(r["payload"]) for r in rows) == raw.tobytes()
    (tmp_path / "p.txt").write_text("# antennas\n1, 2 3\n4 5,6  # last\n")
    assert [tuple(r)[1:] for r in tensors.load_positions(spark, str(tmp_path / "p.txt")).orderBy("a").collect()] == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="expected"):
        tensors.read_packed_voltage(spark, str(tmp_path / "bad.bin"), dims).collect()


def test_views_name_what_they_need():
    assert views.needed("SELECT * FROM sample_power") == ["voltage", "samples", "sample_power"]


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
