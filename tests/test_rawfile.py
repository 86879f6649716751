"""Raw tensors as a data source: several tasks a file, ranges that are skipped, parts and their manifest, failures that leave nothing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from beamquarry.model import Dimensions
from beamquarry.sources import rawfile, tensors
from beamquarry.sources.rawfile import FilteredReader, Layout, TensorReader

DIMS = Dimensions(60, 4, 32, 3)
FRAMES = Layout((("t", "long", 60), ("f", "int", 4)), ("payload",), "bytes", 32)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    data = np.random.default_rng(5).integers(0, 256, DIMS.voltage_bytes).astype(np.uint8).tobytes()
    path = tmp_path_factory.mktemp("raw") / "v.bin"
    path.write_bytes(data)
    return data, str(path)


def read_bytes(reader):
    return sum((b - a) * reader.layout.width for p in reader.partitions() for a, b, _ in reader.reads(p))


def test_a_file_is_read_by_several_tasks(spark, raw):
    data, path = raw
    frames = tensors.read_packed_voltage(spark, path, DIMS, split=1000)
    tasks = frames.select("t", "payload", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in tasks}) == -(-DIMS.voltage_bytes // 992)  # 31 frames of 32 bytes fit in 1000
    rows = frames.orderBy("t", "f").collect()
    assert b"".join(bytes(r["payload"]) for r in rows) == data
    spectra = tensors.read_packed_spectra(spark, path, DIMS, split=1000).orderBy("t").collect()
    assert [bytes(r["payload"]) for r in spectra] == [data[128 * t : 128 * t + 128] for t in range(60)]


def test_filters_skip_ranges(raw, monkeypatch):
    data, path = raw
    whole = TensorReader(path, FRAMES, 512)
    assert read_bytes(whole) == len(data)
    reader = FilteredReader(path, FRAMES, 512)
    left = list(reader.pushFilters([GreaterThanOrEqual(("t",), 10), LessThan(("t",), 15), In(("f",), (1, 2))]))
    assert left == [In(("f",), (1, 2))]
    assert read_bytes(reader) == 5 * 128 and len(reader.partitions()) == 2
    monkeypatch.setattr(rawfile, "GAP_BYTES", 64)  # a channel's frames lie 96 bytes apart: each is read by itself
    one = FilteredReader(path, FRAMES, 1 << 20)
    assert list(one.pushFilters([EqualTo(("f",), 3)])) == []
    assert read_bytes(one) == len(data) // 4
    got = [b for p in one.partitions() for batch in one.read(p) for b in batch["payload"].to_pylist()]
    assert got == [data[128 * t + 96 : 128 * t + 128] for t in range(60)]
    none = FilteredReader(path, FRAMES, 512)
    assert list(none.pushFilters([EqualTo(("t",), 7), EqualTo(("t",), 8)])) == [] and none.partitions() == []


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_filters_give_the_same_rows(spark, raw, allowed):
    data, path = raw
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", allowed)
    try:
        rows = tensors.read_packed_voltage(spark, path, DIMS, split=700).where("t >= 7 AND t < 9 AND f = 2 AND payload IS NOT NULL")
        assert [bytes(r["payload"]) for r in rows.orderBy("t").collect()] == [data[128 * t + 64 : 128 * t + 96] for t in (7, 8)]
        both = tensors.read_packed_voltage(spark, path, DIMS).where("t = 3 OR f = 1")
        assert both.count() == 60 + 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def power(spark, n=60):
    return spark.range(n * 12).select(F.floor(F.col("id") / 12).alias("t"), (F.floor(F.col("id") / 3) % 4).alias("f"), (F.col("id") % 3).alias("b"), (F.col("id") * 0.5).alias("power"))


def test_parts_cover_the_tensor(spark, tmp_path):
    path = tmp_path / "power"
    tensors.write_intensity(power(spark).orderBy(F.rand(1)), str(path), DIMS, split=500)
    manifest = json.loads((path / "manifest.json").read_text())
    parts = manifest["parts"]
    assert manifest["bytes"] == 60 * 12 * 4 and len(parts) > 3
    assert [a for a, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
    joined = b"".join(x.read_bytes() for x in sorted(path.glob("job-*/part-*")))
    assert joined == (np.arange(720) * 0.5).astype("<f4").tobytes()
    (tmp_path / "one.bin").write_bytes(joined)
    for where in (path, tmp_path / "one.bin"):
        back = tensors.read_intensity(spark, str(where), DIMS, split=700)
        assert back.join(power(spark), ["t", "f", "b"]).where(back["power"] == F.col("t") * 6.0 + F.col("f") * 1.5 + F.col("b") * 0.5).count() == 720


@pytest.mark.parametrize("fault", ["gap", "twice", "null", "outside", "raised", "short"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, fault):
    rows = power(spark)
    rows = {
        "gap": lambda: rows.where("t <> 30 OR f <> 2"), "twice": lambda: rows.unionByName(rows.where("t = 5")), "null": lambda: rows.withColumn("power", F.when(F.col("t") != 50, F.col("power"))),
        "outside": lambda: power(spark, 61), "raised": lambda: rows.withColumn("power", F.when(F.col("t") < 55, F.col("power")).otherwise(F.raise_error(F.lit("lost")).cast("double"))),
        "short": lambda: rows.where("t < 59"),
    }[fault]()
    with pytest.raises(Exception, match="gap|once each|nulls|outside|lost|expected"):
        tensors.write_intensity(rows, str(tmp_path / "x"), DIMS, split=500)
    assert not (tmp_path / "x").exists()


def test_an_older_tensor_outlives_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "x")
    tensors.write_intensity(power(spark), path, DIMS, split=500)
    with pytest.raises(Exception, match="expected|gap"):
        tensors.write_intensity(power(spark).where("t < 59"), path, DIMS, split=500)
    assert tensors.read_intensity(spark, path, DIMS).count() == 720
    tensors.write_intensity(power(spark).withColumn("power", F.lit(2.0)), path, DIMS, split=900)
    assert tensors.read_intensity(spark, path, DIMS).where("power = 2").count() == 720
    held = {str(x.relative_to(tmp_path / "x")) for x in (tmp_path / "x").rglob("*") if x.is_file()}
    assert held == {"manifest.json", *(name for _, _, name in json.loads((tmp_path / "x" / "manifest.json").read_text())["parts"])}


def test_a_part_of_another_size_is_refused(spark, raw, tmp_path):
    with pytest.raises(Exception, match="expected"):
        tensors.read_packed_voltage(spark, raw[1], Dimensions(61, 4, 32, 1)).collect()
    with pytest.raises(Exception, match="payloads must have 32 bytes"):
        rows = spark.range(240).select(F.floor(F.col("id") / 4).alias("t"), (F.col("id") % 4).cast("int").alias("f"), F.expr("unhex(repeat('00', if(id = 9, 31, 32)))").alias("payload"))
        tensors.write_packed_voltage(rows, str(tmp_path / "x"), DIMS)
    assert not (tmp_path / "x").exists()


def test_tracker_reads_its_own_ranges(spark, tmp_path):
    """Spectra of 7 windows, the last one short, over tasks of one and of three windows, against the same spectra as rows and against the sums written out."""
    from beamquarry.model import LIGHT_M_S, Trajectory
    from beamquarry.operators import tracker
    from beamquarry.plans import catalog

    dims, path, where = Dimensions(65, 5, 32, 1), Trajectory(0.02, -0.03, 1e-4, 0.0), str(tmp_path / "v")
    data = np.random.default_rng(9).integers(0, 256, (65, 5, 32)).astype(np.uint8)
    hz, positions = 300e6 + np.arange(5) * 1e6, catalog.positions()
    rows = spark.createDataFrame([(t, f, data[t, f].tobytes()) for t in range(65) for f in range(5)], "t long, f int, payload binary")
    tensors.write_packed_voltage(rows, where, dims, split=2000)
    signed = ((data & 15) ^ 8).astype(float) - 8 + 1j * (((data >> 4) ^ 8).astype(float) - 8)
    want = np.empty((65, 5))
    for t in range(65):
        angle = 2 * np.pi / LIGHT_M_S * hz[:, None] * (positions @ np.array(path.at(t // 10 * 10)))
        want[t] = np.abs((signed[t] * np.exp(1j * angle)).sum(axis=1)) ** 2
    for windows in (1, 3):
        got = {r["t"]: r["power"] for r in tracker.track_tensor(spark, where, dims, path, hz, positions, 10, windows).collect()}
        assert sorted(got) == list(range(65)) and np.allclose([got[t] for t in range(65)], want, rtol=1e-4, atol=1e-2)
    spectra = tracker.track_spectra(tensors.read_packed_spectra(spark, where, dims, split=4000), path, hz, positions, 10)
    got = {r["t"]: r["power"] for r in spectra.collect()}
    assert np.allclose([got[t] for t in range(65)], want, rtol=1e-4, atol=1e-2)
