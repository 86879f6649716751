"""Direction search: sums by baseline against whole covariances, phasors by recurrence, factors computed once, state that survives a restart."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamquarry.model import LIGHT_M_S, SearchConfig
from beamquarry.operators import doa
from beamquarry.plans import catalog, views
from beamquarry.streaming import windows

HZ = 300e6 + np.arange(16) * 0.3e6
ODD = catalog.positions() + np.array([[0.01 * (a % 3), 0.0, 0.0] for a in range(32)])


def cells(n, seed=1):
    lm = np.random.default_rng(seed).uniform(-0.6, 0.6, (n, 2))
    return doa.in_disk(lm)


def trigonometric(hz, positions, look):
    return np.exp(-2j * np.pi / LIGHT_M_S * hz[:, None, None] * (look @ positions.T)[None])


@pytest.mark.parametrize("positions", [catalog.positions(), catalog.positions()[::-1] + [3.0, -2.0, 5.0], catalog.positions()[:5], ODD, catalog.positions()[[0, 3, 9, 17]]])
def test_steering_in_both_forms(positions):
    look = cells(50)
    assert np.allclose(doa.steering(HZ, positions, look), trigonometric(HZ, positions, look), atol=2e-6)


def test_lattices_are_told_from_others():
    plane = doa.Plane.of(catalog.positions())
    assert (plane.nx, plane.ny, plane.dx, plane.dy) == (8, 4, 0.6, 0.6)
    assert doa.Plane.of(catalog.positions()[[0, 3, 6]]).nx == 3  # with a pitch of three
    for other in (ODD, catalog.positions()[[0, 1, 3]], np.zeros((4, 3)), np.c_[catalog.positions()[:, :2], np.arange(32)], catalog.positions()[:1]):
        assert doa.Plane.of(other) is None


def test_fewer_exponentials_are_faster():
    x = np.arange(256)
    positions = np.stack([x % 16 * 0.6, x // 16 * 0.6, 0.0 * x], axis=1)
    look = cells(256)

    def seconds(f):
        found = []
        for _ in range(3):
            begun = time.perf_counter()
            f(HZ, positions, look)
            found.append(time.perf_counter() - begun)
        return min(found)

    assert seconds(doa.steering) < seconds(trigonometric)


def test_lag_powers_are_those_of_the_matrix():
    rng = np.random.default_rng(2)
    positions, plane = catalog.positions(), doa.Plane.of(catalog.positions())
    x = rng.standard_normal((20, 32)) + 1j * rng.standard_normal((20, 32))
    r = doa.covariance(x, kind=np.complex128)
    lags = np.zeros((2 * plane.ny - 1, 2 * plane.nx - 1), complex)
    for i in range(32):
        for j in range(32):
            lags[plane.y[i] - plane.y[j] + plane.ny - 1, plane.x[i] - plane.x[j] + plane.nx - 1] += r[i, j]
    look = cells(40)
    a = trigonometric(HZ[:1], positions, look)[0]
    want = np.einsum("ci,ij,cj->c", a.conj(), r, a).real
    assert np.allclose(doa.lag_powers(lags[None], HZ[:1], plane, look)[0], want)
    config = SearchConfig()
    for centre in ((0.0, 0.0), (0.9, 0.3)):  # the second grid reaches beyond the disk
        axes = [c + np.linspace(-0.2, 0.2, 7) for c in centre]
        one, two = (kind(v[None], HZ[:1], positions, config).grid(*axes) for kind, v in ((doa.LagScan, lags), (doa.MatrixScan, r.astype(np.complex64))))
        assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1], rtol=1e-4)


SETTINGS = [{}, {"forgetting": 0.9}, {"interpolate": True, "interpolation": "corrected"}, {"levels": 0, "interpolate": True}, {"grid": 9, "levels": 4, "fov_l": 0.3}]


@pytest.mark.parametrize("settings", SETTINGS)
def test_lags_give_the_estimates_of_matrices(spark, sf_dir, settings):
    config = SearchConfig(spectra=64, **settings)
    frames, positions = views.frames(spark, sf_dir), catalog.positions()
    lags = doa.observed(frames, positions, config)
    assert lags.columns[-1] == "lags"
    runs = [doa.estimate(x, HZ, positions, config).orderBy("shard_id", "w").collect() for x in (lags, doa.covariances(frames, 32, 64))]
    assert len({r["shard_id"] for r in runs[0]}) > 1 and len(runs[0]) == len(runs[1])
    for a, b in zip(*runs, strict=True):
        assert (a["shard_id"], a["w"]) == (b["shard_id"], b["w"]) and np.allclose(a[2:5], b[2:5], atol=1e-5)


def test_what_needs_the_matrix():
    positions = catalog.positions()
    assert doa.uses_lags(positions, SearchConfig())
    for config, where in ((SearchConfig(estimator="capon"), positions), (SearchConfig(subarray=8), positions), (SearchConfig(), ODD)):
        assert not doa.uses_lags(where, config)
    with pytest.raises(ValueError, match="planar"):
        doa.lag_sums(None, ODD, 64)


def test_tasks_sum_before_the_shuffle(spark):
    """4 keys of 100 frames: a row for each key and batch is shuffled, not one for each frame."""
    frames = spark.range(0, 400, 1, 2).select(F.lit(0).alias("shard_id"), F.floor(F.col("id") / 4).alias("t"), (F.col("id") % 4).cast("int").alias("f"), F.expr("unhex(repeat('12', 32))").alias("payload"))
    out = doa.lag_sums(frames, catalog.positions(), 100)
    rows = out.collect()
    assert [r["snapshots"] for r in rows] == [100] * 4
    sample = np.full(32, 2 + 1j)
    plane = doa.Plane.of(catalog.positions())
    got = np.frombuffer(rows[0]["lags"], np.complex128).reshape(7, 15)
    assert np.isclose(got[plane.ny - 1, plane.nx - 1], (abs(sample) ** 2).sum()) and np.isclose(got[0, 0], 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


def test_one_factor_for_each_channel_and_window(monkeypatch):
    calls = []
    inner = np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda m: calls.append(1) or inner(m))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5, 60, 32)) + 1j * rng.standard_normal((5, 60, 32))
    r = np.stack([doa.covariance(y) for y in x])
    config = SearchConfig(estimator="capon", levels=3)
    doa.search(doa.MatrixScan(r, HZ[:5], catalog.positions(), config), np.array([0.0, 0.0, 1.0]), config)
    assert len(calls) == 5


def test_parabola_in_both_modes():
    """The parabola through (-1, 1), (0, 3), (1, 2) has its peak at 1/6; "reference" stays at peaks and moves by the same rule in troughs."""
    peak = np.polynomial.Polynomial.fit([-1, 0, 1], [1, 3, 2], 2).deriv().roots()[0]
    assert doa.parabola(1.0, 3.0, 2.0, "corrected") == pytest.approx(peak) == pytest.approx(1 / 6)
    assert doa.parabola(2.0, 3.0, 1.0, "corrected") == pytest.approx(-1 / 6)
    assert doa.parabola(1.0, 3.0, 2.0, "reference") == 0.0
    assert doa.parabola(3.0, 1.0, 2.0, "reference") == pytest.approx(-1 / 6)
    assert doa.parabola(2.0, 1.0, 3.0, "reference") == pytest.approx(1 / 6)
    assert doa.parabola(3.0, 1.0, 2.0, "corrected") == 0.0
    assert doa.parabola(1.0, 2.0, 3.0, "corrected") == doa.parabola(1.0, 2.0, 3.0, "reference") == 0.0  # a straight line has no extremum
    assert doa.parabola(0.0, 1.0, 1.9, "corrected") == doa.parabola(0.0, 1.0, 9.0, "reference") == 0.5  # at most half a cell


def test_interpolation_moves_towards_a_source():
    """A source between cells: the corrected mode comes closer than the grid, the other one never moves at a peak."""
    positions, true = catalog.positions(), np.array([[0.031, -0.017, 0.0]])
    true[0, 2] = np.sqrt(1 - 0.031**2 - 0.017**2)
    a = trigonometric(HZ, positions, true)[:, 0]
    r = np.einsum("fi,fj->fij", a, a.conj()).astype(np.complex64)
    found = {}
    for kind in ("none", "reference", "corrected"):
        config = SearchConfig(grid=17, levels=0, interpolate=kind != "none", interpolation="corrected" if kind == "none" else kind)
        here, _ = doa.search(doa.MatrixScan(r, HZ, positions, config), np.array([0.0, 0.0, 1.0]), config)
        found[kind] = np.hypot(*(here[:2] - true[0, :2]))
    assert found["corrected"] < 0.5 * found["none"] and found["reference"] == found["none"]


def test_a_stream_goes_on_after_a_restart(spark, sf_dir, tmp_path):
    """Batches of windows, the query stopped between each two and started again from its checkpoint, give the rows of the batch form; late windows do not come back."""
    config = SearchConfig(spectra=64, forgetting=0.8)
    lags = doa.observed(views.frames(spark, sf_dir), catalog.positions(), config).cache()
    want = {(r["shard_id"], r["w"]): r for r in doa.estimate(lags, HZ, catalog.positions(), config).collect()}
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    for k in range(4):
        batch = lags.where(F.col("w") % 4 == k)
        if k == 3:
            batch = batch.unionByName(lags.where(F.col("w") % 4 == 0))  # late
        batch.coalesce(1).write.mode("append").parquet(source)
        with windows.keyed_state(spark):
            stream = spark.readStream.schema(lags.schema).parquet(source)
            query = windows.tracked(stream, HZ, catalog.positions(), config).writeStream.format("parquet").outputMode("append")
            query.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r["shard_id"], r["w"]): r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(want) and got.keys() == want.keys()
    assert all(np.allclose(got[k][2:], want[k][2:], atol=1e-9) for k in want)
    assert "RocksDB" not in spark.conf.get(windows.STATE_PROVIDER)
