"""Steps that must not grow faster than their input: one shuffle of samples, even buckets, ranks selected where the values are."""

import re

import pytest
from pyspark.sql import functions as F

from beamquarry.operators import asof, beamform
from beamquarry.plans import catalog, products


def shuffles(df):
    """Shuffles by key in the plan; fixed tables go by broadcast, and a total goes into one partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (\w+partitioning\([^)]*\))", plan) if "_groupingexpression" not in x]


def test_places_in_far_clumps_fill_all_buckets(spark):
    places = spark.range(6000).select((F.col("id") % 6 * 1e9 + F.col("id")).alias("_x"))
    sizes = [r["count"] for r in asof.bucketed(places, 32).groupBy("_b").count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 400 and sum(sizes) == 6000


def test_neighbours_are_found_across_odd_places(spark):
    places = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 1.0, 1.5, 2.0, 1e9, float("inf"), float("nan"), None, 1.5)], "x double")
    anchors = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "c"), (1e8, "d")], "x double, name string")
    for buckets in (1, 2, 7):
        got = {str(r["x"]): (r["below"] and r["below"]["name"], r["above"] and r["above"]["name"]) for r in asof.neighbours(places, anchors, "x", buckets).collect()}
        want = {"-5.0": (None, "a"), "0.0": (None, "a"), "1.0": ("a", "b"), "1.5": ("a", "b"), "2.0": ("b", "d"), "1000000000.0": ("d", None), "inf": ("d", None), "nan": ("d", None)}
        assert got == want


@pytest.mark.parametrize(
    "name",
    ["two_stage_integration", "dequantize", "tile_params", "quantize_codes", "diff_stats", "quantization_stats", "window_stats", "beamform_integrated", "beamform_relational"],
)
def test_samples_are_shuffled_once(spark, sf_dir, name):
    assert len(shuffles(catalog.QUERIES[name](spark, sf_dir))) == 1


@pytest.mark.parametrize(("name", "then"), [("peak_beam", "b#"), ("top_beams", "b#"), ("marginals_grouping_sets", "spark_grouping_id")])
def test_power_is_summed_before_it_is_shuffled(spark, sf_dir, name, then):
    """Behind the shuffle of samples there is only one of sums by beam or by axis."""
    found = [x for x in shuffles(catalog.QUERIES[name](spark, sf_dir)) if not re.match(r"hashpartitioning\(_w\d+#", x)]  # the window over the best few
    first, *more = sorted(found, key=lambda x: then in x)
    assert re.match(r"hashpartitioning\(t#\w+, \d+", first) and all(then in x for x in more)


def test_beams_beyond_a_row_of_sums_and_missing_weights(spark):
    """Twenty beams in two rows of sums; a beam without weights at a place has no power there."""
    weights = [(b, f, a, (b + a) % 3 - 1, (b * f + a) % 3 - 1) for b in range(20) for f in range(3) for a in range(4) if (b + f) % 5]
    voltage = [(t, f, a, (t * 37 + f * 11 + a * 5) % 256) for t in range(30) for f in range(3) for a in range(4) if (t + a) % 4]
    want = {}
    for t, f, a, byte in voltage:
        for b, wf, wa, wr, wi in weights:
            if (wf, wa) == (f, a):
                want[t, f, b] = want.get((t, f, b), 0) + (wr + 1j * wi) * complex(beamform.SAMPLES[byte])
    tables = spark.createDataFrame(voltage, "t long, f int, a int, byte int"), spark.createDataFrame(weights, "b int, f int, a int, wr int, wi int")
    got = {(r["t"], r["f"], r["b"]): r["power"] for r in beamform.beamform_packed(*tables).collect()}
    assert got == {k: round(abs(v) ** 2) for k, v in want.items()}
    sums = beamform.integrate(beamform.beamform_windows(*tables, 8), 8).collect()
    assert {(r["w"], r["f"], r["b"]): r["power"] for r in sums} == {k: sum(p for (t, f, b), p in got.items() if (t // 8, f, b) == k) for k in {(t // 8, f, b) for t, f, b in got}}


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(beamform, "TASK_VALUES", 100)
    assert beamform.dealt(spark.range(1000), ("id",), 2).rdd.getNumPartitions() == 20


def test_masked_samples_are_shuffled_beside_their_mask(spark, sf_dir, monkeypatch):
    """Tasks of the mask join grow with the rows, and nothing is shuffled after it."""
    monkeypatch.setattr(beamform, "TASK_VALUES", 16 * 500)
    found = shuffles(catalog.QUERIES["loss_mask_filtered"](spark, sf_dir))
    tasks = -(-catalog.V.voltage(spark, sf_dir).count() // 500)
    assert len(found) == 2 and all(x.endswith(f", {tasks})") for x in found)


def test_pairs_of_samples_are_made_where_their_window_is(spark, sf_dir):
    assert len(shuffles(catalog.QUERIES["covariance_relational"](spark, sf_dir))) == 1


def test_medians_of_many_values_are_selected(spark, sf_dir, monkeypatch):
    """The wide table is the same if its medians are selected by rank, as they are beyond 5,000,000 values."""
    want = sorted(map(tuple, catalog.QUERIES["wide_summary"](spark, sf_dir).collect()))
    plain = products.percentiles
    monkeypatch.setattr(products, "percentiles", lambda rows, keys, wanted: plain(rows, keys, wanted, 100))
    assert sorted(map(tuple, catalog.QUERIES["wide_summary"](spark, sf_dir).collect())) == want
