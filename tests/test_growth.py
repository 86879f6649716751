"""Queries of windows and tiles on tables of copies: the rows of the SQL from many small tasks, and one shuffle of samples."""

import duckdb
import pytest
from pyspark.sql import functions as F

from beamquarry.operators import beamform, compare
from beamquarry.plans import catalog
from tests.test_array import plain
from tests.test_dealt import shuffles

COPIES = 3
TILED = ["dequantize", "tile_params", "quantize_codes", "diff_stats", "quantization_stats", "window_stats", "compare_metrics", "output_stats"]


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    """Line items repeated with keys that go on; copies meet inside a window, as 1,500 keys are no whole number of windows."""
    path = str(tmp_path_factory.mktemp("copies"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shifted = line.crossJoin(spark.range(COPIES).withColumnRenamed("id", "copy"))
    for key, step in (("l_orderkey", 1500), ("l_partkey", 200), ("l_suppkey", 10)):
        shifted = shifted.withColumn(key, F.col(key) + F.col("copy") * step)
    shifted.drop("copy").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", [*TILED, "top_beams"])
def test_rows_from_many_tasks_are_those_of_the_sql(spark, copies, monkeypatch, name):
    """Thirty tasks and more in place of four."""
    monkeypatch.setattr(beamform, "TASK_VALUES", 16 * 600)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{copies}/lineitem.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, copies), con.sql(catalog.ORACLE[name])
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["compare_metrics", "output_stats"])
def test_compared_values_are_stored_behind_one_shuffle(spark, sf_dir, monkeypatch, name):
    """The plan of the answer begins at the stored values, so the shuffles before them are counted where they are stored."""
    stored, kept = [], compare.kept
    monkeypatch.setattr(compare, "kept", lambda rows, to: stored.append(shuffles(rows)) or kept(rows, to))
    catalog.QUERIES[name](spark, sf_dir)
    assert [len(x) for x in stored] == [1]
