"""What has no SQL: the validation chain, streams against batches, engines against each other, readers' refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamquarry.model import Dimensions, SearchConfig, ShardDescriptor, Trajectory, check_tracker, resolve_channels
from beamquarry.operators import beamform, burst, compare, doa, geometry, tracker
from beamquarry.plans import catalog, views
from beamquarry.operators.percentiles import percentiles
from beamquarry.session import kept
from beamquarry.sources import records, synthetic, tensors

SHAPE = ("x", 30.0, 0.8, 0.004, 0.002, -1.0, 0.0, 25.0)


@pytest.fixture(scope="module")
def bench(spark):
    return burst.Bench(geometry.channels(spark, 16, 400e6, 25e6), 2048, kept, n_ant=64)


def test_chain_recovers_a_burst(bench):
    fall = bench.waterfall(SHAPE)
    on = bench.sweep_recovery(fall, SHAPE).first()
    assert on["passed"] and on["snr"] > 10
    off = bench.sweep_recovery(fall, SHAPE, off_grid=0.5).first()
    assert off["passed"] and 0 < off["dm_error"] <= 5.0
    refit = bench.refit(fall, SHAPE).first()
    assert refit["passed"] and refit["err_t0_ms"] < 10 and refit["err_gamma"] < 1.0
    wrong = (*SHAPE[:2], SHAPE[2] + 0.1, *SHAPE[3:])
    assert not bench.refit(fall, wrong).first()["passed"]


def test_beam_falls_and_array_scales(bench):
    assert bench.off_boresight(SHAPE, (0.0, 0.05, 0.1, 0.15)).agg(F.bool_and("passed")).first()[0]
    scaling = bench.array_scaling(SHAPE).first()
    assert 0.2 < scaling["slope"] < 0.8


def test_scattering_tail_is_convolved():
    t = np.arange(512) / 1000.0
    flat, tailed = burst.pulse(t, 0.2, 0.004, 0.0, 1e-3), burst.pulse(t, 0.2, 0.004, 0.02, 1e-3)
    k = np.exp(-np.arange(161) / 20.0)
    want = np.convolve(flat, k / k.sum())[80 : 80 + 512]
    assert np.allclose(tailed, want) and abs(tailed.sum() - flat.sum()) < 1e-6


def test_stream_equals_batch(spark, sf_dir):
    config = SearchConfig(spectra=catalog.FRAME_SPECTRA, forgetting=0.9)
    covs = doa.covariances(views.frames(spark, sf_dir), views.ANTENNAS, config.spectra)
    hz = 300e6 + np.arange(views.FRAME_CHANNELS) * 0.3e6
    want = {r["w"]: (r["l"], r["m"]) for r in doa.estimate(covs, hz, catalog.positions(), config).collect()}
    got = {r["w"]: (r["l"], r["m"]) for r in catalog.QUERIES["stream_tracker_state"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[w], want[w], atol=1e-4) for w in want)


def test_engines_agree(spark):
    dims = Dimensions(8, 3, 32, 1)
    frames = beamform.to_frames(synthetic.noise(spark, dims, 3), 32)
    path, channels, antennas = Trajectory(0.02, -0.03, 1e-4, -2e-4), geometry.channels(spark, 3), geometry.antennas(spark, 32)
    found = [{(r["t"], r["f"]): r["power"] for r in tracker.run_engine(e, frames, path, channels, antennas, 2).collect()} for e in tracker.ENGINES]
    assert len(found[0]) == 24
    assert all(abs(other[k] - v) <= 1e-2 + 1e-4 * v for other in found[1:] for k, v in found[0].items())
    with pytest.raises(ValueError, match="engine is one of"):
        tracker.run_engine("gpu", frames, path, channels, antennas, 2)


def test_whole_spectra_equal_frames(spark):
    dims = Dimensions(9, 3, 32, 1)
    frames = beamform.to_frames(synthetic.noise(spark, dims, 5), 32)
    rows = frames.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("f", "payload"))).alias("s")).select("t", F.expr("reduce(s, X'', (a, x) -> concat(a, x.payload))").alias("payload"))
    path, hz = Trajectory(0.02, -0.03, 1e-4, -2e-4), [300e6, 300.3e6, 300.6e6]
    want = {(r["t"], r["f"]): r["power"] for r in tracker.track_frames(frames, path, hz, catalog.positions(), 4).collect()}
    got = tracker.track_spectra(rows, path, hz, catalog.positions(), 4, slice_rows=2).select("t", F.posexplode("power").alias("f", "power")).collect()
    assert len(got) == len(want) == 27
    assert all(abs(r["power"] - want[r["t"], r["f"]]) <= 1e-2 + 1e-4 * r["power"] for r in got)


def test_search_without_a_grid_tracks_the_prior(spark):
    antennas, channels = geometry.antennas(spark, 32), geometry.channels(spark, 4)
    frames = beamform.to_frames(synthetic.point_source(spark, 4, channels, antennas, 0.0, 0.0, 4.0), 32).withColumn("shard_id", F.lit(0))
    estimates, power = doa.run(frames, 300e6 + np.arange(4) * 0.3e6, catalog.positions(), SearchConfig(spectra=2, grid=1))
    assert {(r["l"], r["m"]) for r in estimates.collect()} == {(0.0, 0.0)}
    assert {round(r["power"]) for r in power.collect()} == {(32 * 4) ** 2}


def test_smoothed_covariance_by_loops():
    rng = np.random.default_rng(4)
    x = rng.integers(-7, 8, (5, 8)) + 1j * rng.integers(-7, 8, (5, 8))
    p, want = 5, np.zeros((5, 5), complex)
    for s in range(4):
        part = x[:, s : s + p]
        want += sum(np.outer(row, row.conj()) for row in part) / 5 / 4
    flip = np.eye(p)[::-1]
    want = (want + flip @ want.conj() @ flip) / 2
    assert np.allclose(doa.covariance(x, p), want, atol=1e-3)
    assert np.allclose(np.trace(doa.loaded(want, 0.1)), np.trace(want) * 1.1)


def test_capon_by_inverse():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 32)) + 1j * rng.standard_normal((40, 32))
    r = doa.covariance(x)[None]
    look = np.array([[0.0, 0, 1], [0.1, 0.05, 0.99]])
    a = doa.steering(np.array([3.2e8]), catalog.positions(), look)
    inverse = np.linalg.inv(doa.loaded(r[0], 1e-2))
    want = [1 / (v.conj() @ inverse @ v).real for v in a[0]]
    assert np.allclose(doa.spectrum(r, a, "capon", 1e-2), want, rtol=1e-3)
    assert np.isfinite(doa.spectrum(np.zeros_like(r), a, "capon", 0.0)).all()


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="full band"):
        ShardDescriptor(1, absolute_frequency_start=337).check()
    assert resolve_channels() == ("0", 336, 0) and resolve_channels(None, 672) == ("both", 672, 0) and resolve_channels("1") == ("1", 336, 336)
    for buffer, n in ((None, 400), ("2", None), ("both", 336)):
        with pytest.raises(ValueError):
            resolve_channels(buffer, n)
    check_tracker(Dimensions(640, 336, 64, 1), Trajectory.from_direction((0.0, 0.0, 1.0), (1e-6, 0.0, 0.0)), 320)
    for dims, path, spectra in ((Dimensions(640, 336, 64, 2), Trajectory(), 320), (Dimensions(640, 336, 64, 1), Trajectory(), 0), (Dimensions(640, 336, 64, 1), Trajectory(l_rate=float("nan")), 320)):
        with pytest.raises(ValueError):
            check_tracker(dims, path, spectra)
    for start, rate in (((0.5, 0.5, 0.5), (0.0,) * 3), ((0.0, 0.0, 1.0), (float("inf"), 0.0, 0.0))):
        with pytest.raises(ValueError):
            Trajectory.from_direction(start, rate)
    for bad in (SearchConfig(estimator="music"), SearchConfig(forgetting=0), SearchConfig(subarray=99), SearchConfig(grid=-1), SearchConfig(fov_l=0.0)):
        with pytest.raises(ValueError):
            bad.check(32)
    weights = views.integer_weights(spark, 2, 2)
    with pytest.raises(ValueError, match="expected"):
        tensors.write_weights(weights, str(tmp_path / "w.bin"), Dimensions(1, 2, 32, 3))
    assert not (tmp_path / "w.bin").exists()
    empty = spark.createDataFrame([], "name string, value double")
    with pytest.raises(ValueError, match="no data"):
        records.require_rows(empty, "x")
    two = spark.createDataFrame([(336,), (672,)], "n_freq int")
    with pytest.raises(Exception, match="several channel counts"):
        compare.for_buffer(two, None).collect()
    with pytest.raises(KeyError):
        burst.benchmark_burst(spark, "none")
    assert burst.benchmark_burst(spark, burst.CATALOG[1][0]).first()["dm"] == 1205.40
    payload = spark.createDataFrame([(0, 0, 0, b"x" * 32)], "shard_id int, t long, f int, payload binary")
    mask = spark.createDataFrame([(0, 0, 0, True)], "shard_id int, t long, f int, valid boolean")
    tensors.write_packed_shards(payload, mask, synthetic.shard_table(spark), str(tmp_path / "set"))
    assert tensors.read_packed_shards(spark, str(tmp_path / "set"), 0).count() == 1
    with pytest.raises(ValueError, match="mask size, payload size"):
        tensors.read_packed_shards(spark, str(tmp_path / "set"), dims=Dimensions(1, 1, 32, 1))
    (tmp_path / "m.txt").write_text("format=x\n")
    with pytest.raises(ValueError, match="missing metadata"):
        tensors.read_quantized_metadata(spark, str(tmp_path / "m.txt"))


def test_percentiles_by_two_passes(spark):
    rng = np.random.default_rng(3)
    groups = {"many": rng.normal(0, 50, 3000).round(1), "few": np.array([4.0]), "ties": np.repeat([1.0, 7.0, 1e12], [500, 3, 4]), None: rng.exponential(9, 77)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"a": ("v", 0.5, "linear"), "b": ("v", 0.99, "nearest"), "c": ("v", 0.95, "linear"), "d": ("v", 0.0, "nearest"), "e": ("v", 1.0, "linear")}
    for buffered in (0, 10**9):
        got = {r["k"]: r for r in percentiles(df, ["k"], wanted, buffered, bins=64).collect()}
        assert set(got) == {*groups, "none"} and got["none"]["a"] is None
        for k, v in groups.items():
            v = np.sort(v)
            assert np.allclose([got[k][x] for x in "ace"], [np.percentile(v, q) for q in (50, 95, 100)])
            assert got[k]["b"] == v[int(np.ceil(len(v) * 0.99)) - 1] and got[k]["d"] == v[0]
    whole = percentiles(df, [], {"m": ("v", 0.5, "linear")}, 0).first()["m"]
    assert np.isclose(whole, np.median(np.concatenate(list(groups.values()))))


def test_report_drops_private_fields_at_any_depth(spark):
    rows = spark.sql("SELECT 1 AS a, 2 AS _b, named_struct('c', 3, '_d', 4, 'e', array(named_struct('_f', 5, 'g', 6))) AS s, map('x', 1, '_y', 2) AS m")
    assert records.report_json(rows).first()[0] == '{"a":1,"s":{"c":3,"e":[{"g":6}]},"m":{"x":1}}'
