"""Percentiles under skew, the sweep with shared profiles, folds in two levels, joins by range, sinks that repeat a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamquarry.operators import burst, percentiles as module
from beamquarry.operators.percentiles import percentiles
from beamquarry.plans import views

WANTED = {"a": ("v", 0.5, "linear"), "b": ("v", 0.99, "nearest"), "c": ("v", 0.953, "linear"), "d": ("v", 0.0, "nearest"), "e": ("v", 1.0, "linear"), "f": ("u", 0.25, "linear")}
RNG = np.random.default_rng(6)
SHAPES = {
    "outlier": np.append(RNG.normal(0, 1, 20_000), 1e12),
    "infinities": np.concatenate([RNG.normal(0, 1, 9000), [np.inf] * 300, [-np.inf] * 700]),
    "one value": np.full(8000, 3.25),
    "two values": np.repeat([1.0, 2.0], 4000),
    "heavy middle": np.concatenate([RNG.uniform(-5, 5, 3000), np.full(9000, 0.125)]),
    "powers": 10.0 ** RNG.uniform(-300, 300, 6000),
    "nan": np.concatenate([RNG.normal(0, 1, 5000), [np.nan] * 200]),
    "nan only": np.full(40, np.nan),
    "few": np.array([7.0]),
}


@pytest.mark.parametrize("bins", [8, 256])
def test_percentiles_of_all_shapes(spark, monkeypatch, bins):
    """Brackets of 50 values at most: no task puts more in order, whatever the shape."""
    rows = [(k, float(x), float(i % 17)) for k, v in SHAPES.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, v double, u double").repartition(4).cache()
    sizes, inner = [], module._narrowed

    def narrowed(values, brackets, n):
        sizes.append(brackets.agg(F.sum("_in")).first()[0])
        return inner(values, brackets, n)

    monkeypatch.setattr(module, "_narrowed", narrowed)
    got = {r["k"]: r for r in percentiles(df, ["k"], WANTED, 0, bins, few=50).collect()}
    want = {r["k"]: r for r in percentiles(df, ["k"], WANTED, 10**9).collect()}
    for k, v in SHAPES.items():
        for name in WANTED:
            assert got[k][name] == pytest.approx(want[k][name], rel=1e-12, nan_ok=True) or name in "ac" and k == "infinities", (k, name)
    assert len(sizes) <= (8 if bins == 8 else 3) and sizes == sorted(sizes, reverse=True)


def test_no_bracket_of_more_than_a_few(spark):
    """What is put in order is bounded: 12 values of 30,000, nine tenths of which are equal and one of which lies far away."""
    df = spark.createDataFrame([(float(x),) for x in [1e300] + [5.0] * 27_000 + list(RNG.normal(0, 1, 3000))], "v double")
    got = percentiles(df, [], {"low": ("v", 0.05, "nearest"), "mid": ("v", 0.5, "nearest"), "top": ("v", 1.0, "nearest")}, 0, 64, few=12).first()
    x = np.sort([r["v"] for r in df.collect()])
    assert (got["low"], got["mid"], got["top"]) == (x[int(np.ceil(len(x) * 0.05)) - 1], 5.0, 1e300)
    assert percentiles(df.where("v IS NULL").unionByName(spark.sql("SELECT cast(NULL AS double) AS v")), [], {"m": ("v", 0.5, "linear")}, 0).first()["m"] is None


# --- sweep


def shift_grid(spark, dm, steps, reach, channels=16):
    table = burst.shifts(views.burst_channels(spark), burst.trial_table(spark, dm, steps, reach))
    return table, table.toPandas().pivot(index="trial", columns="f", values="shift").to_numpy()


def test_a_tree_moves_fewer_rows(spark):
    _, fine = shift_grid(spark, 100.0, 160, 0.01)
    _, coarse = shift_grid(spark, 100.0, 51, 0.4)
    levels = burst.best_tree(fine)
    assert len(levels) > 1 and sum(map(len, levels)) < 0.6 * fine.size
    assert len(burst.best_tree(coarse)) == 1 and sum(map(len, burst.best_tree(coarse))) == coarse.size  # no two trials have anything in common


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("fanout", [2, 3, 4, 16])
def test_shared_profiles_are_exact(spark, monkeypatch, wrap, fanout):
    monkeypatch.setattr(burst, "best_tree", lambda shift: burst.shift_tree(shift, fanout))
    n = 300
    fall = spark.range(n * 16).select((F.col("id") % n).alias("t"), F.floor(F.col("id") / n).cast("int").alias("f"), (F.hash("id") % 1000).cast("long").alias("power")).where("t % 7 <> 3 OR f > 2")
    shift, _ = shift_grid(spark, 10.0, 12, 0.05)
    shift = shift.where("f <> 5")  # a channel without a shift is in no profile
    want = {(r["trial"], r["t"]): r["power"] for r in burst.profile(burst.dedisperse(fall, shift, n, wrap), n).collect()}
    got = {(r["trial"], r["t"]): r["power"] for r in burst.shared_profiles(fall, shift, n, wrap).collect()}
    assert got == want and len(got) == 12 * n


# --- folds


@pytest.mark.parametrize("forgetting", [0.9, 0.3, 0.9999])
def test_a_fold_in_blocks_is_the_fold(spark, forgetting):
    from beamquarry.operators import doa

    rng = np.random.default_rng(1)
    series = {k: sorted(rng.choice(900, n, replace=False).tolist()) for k, n in (("a", 700), ("b", 40), ("c", 1), (None, 300))}
    rows = [(k, int(w), float(rng.normal(5, 3))) for k, ws in series.items() for w in ws]
    df = spark.createDataFrame(rows, "k string, w long, v double").repartition(5)
    for block in (7, 4096):
        got = {(r["k"], r["w"]): r["folded"] for r in doa.rls_fold(df, "k", "w", "v", forgetting, block).collect()}
        assert len(got) == len(rows)
        for k in series:
            held = None
            for _, w, v in [r for r in rows if r[0] == k]:
                held = v if held is None else forgetting * held + (1 - forgetting) * v
                assert got[k, w] == pytest.approx(held, rel=1e-12)


def test_no_window_over_a_whole_key(spark):
    from beamquarry.operators import doa

    plan = doa.rls_fold(spark.range(10).selectExpr("1 AS k", "id AS w", "1.0D AS v"), "k", "w", "v", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


# --- joins by nearness


@pytest.mark.parametrize("buckets", [1, 5, 1024])
@pytest.mark.parametrize("count", [0, 1, 2, 3, 40])
def test_neighbours_and_lines_between(spark, buckets, count):
    from beamquarry.operators import asof

    rng = np.random.default_rng(count)
    hz = np.sort(rng.choice(1000, count, replace=False)).astype(float)
    gain = rng.normal(0, 1, count)
    anchors = spark.createDataFrame([(float(h), float(g), f"n{i}") for i, (h, g) in enumerate(zip(hz, gain, strict=True))], "hz double, gain double, name string")
    places = [float(x) for x in rng.uniform(-100, 1100, 60)] + hz.tolist() + [3.0] * 30 + [None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "id long, hz double")
    near = {r["id"]: r for r in asof.with_neighbours(rows, anchors, "hz", buckets).collect()}
    lines = {r["id"]: r["gain"] for r in asof.interpolated(rows, anchors.drop("name"), "hz", ["gain"], buckets).collect()}
    assert len(near) == len(lines) == len(places)
    for i, p in enumerate(places):
        if p is None:
            assert near[i]["below"] is None and near[i]["above"] is None and lines[i] is None
            continue
        k = int(np.searchsorted(hz, p, "right"))
        assert (near[i]["below"] and near[i]["below"]["name"]) == (f"n{k - 1}" if k else None)
        assert (near[i]["above"] and near[i]["above"]["name"]) == (f"n{k}" if k < count else None)
        if count < 2:
            assert lines[i] == (gain[0] if count else None)
        else:
            a = min(max(k - 1, 0), count - 2)
            assert lines[i] == pytest.approx(gain[a] + (p - hz[a]) * (gain[a + 1] - gain[a]) / (hz[a + 1] - hz[a]), rel=1e-9, abs=1e-9)


# --- sinks


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    """The query fails after its sink has written the second batch; started again it repeats that batch, and every window is there once."""
    from beamquarry.streaming import windows

    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    rows = spark.range(640).select(F.col("id").alias("t"), F.lit(0).alias("f"), (F.col("id") % 5).alias("power"))
    for k in range(4):
        rows.where(F.floor(F.col("t") / 160) == k).coalesce(1).write.mode("append").parquet(source)
    inner, seen = windows.by_batch(out), []

    def sink(batch, number):
        inner(batch, number)
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("lost after writing")

    def start():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        windows.batched_windows(stream, 64, sink, state, late_samples=1000).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        start()
    start()
    assert seen.count(1) == 2 and sorted(set(seen))[:4] == [0, 1, 2, 3]
    got = sorted((r["w"], r["power"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(w, sum(t % 5 for t in range(64 * w, 64 * w + 64)), 64) for w in range(10)]


def test_three_tables_by_window(spark):
    from beamquarry.operators import compare

    true, prior, found = (spark.createDataFrame([(w, 0.1 * k, 0.01 * w) for w in ws], "w long, l double, m double") for k, ws in ((0, range(5)), (1, range(4)), (2, range(1, 9))))
    rows = compare.joined_directions(true, prior, found).orderBy("w").collect()
    assert [(r["w"], r["l"], r["l_prior"], r["l_est"], r["m_est"]) for r in rows] == [(w, 0.0, 0.1, 0.2, 0.01 * w) for w in (1, 2, 3)]
    assert compare.direction_errors(compare.joined_directions(true, prior, found)).first()["mean_error"] == pytest.approx(0.2)
