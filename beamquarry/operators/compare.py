"""Comparison of power cubes, latency summaries and timing groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamquarry.operators.percentiles import BUFFERED, percentiles
from beamquarry.session import kept


def paired(reference: DataFrame, candidate: DataFrame, keys: list[str], value: str = "power") -> DataFrame:
    """Both cubes side by side as `r` and `c`. Rows that only one has stay, with a null on the other side."""
    return reference.select(*keys, F.col(value).cast("double").alias("r")).join(candidate.select(*keys, F.col(value).cast("double").alias("c")), keys, "full")


def unmatched(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("r").isNull() | F.col("c").isNull()).alias("unmatched"))


def _difference() -> tuple[Column, Column, Column]:
    r, c = F.col("r"), F.col("c")
    return r, c, F.abs(c - r)


def metrics(pairs: DataFrame, absolute: float, relative: float, buffered: int = BUFFERED) -> DataFrame:
    """Largest absolute error; mean, 99th percentile (linear) and largest relative error; correlation; values outside tolerance."""
    r, c, error = _difference()
    rel = F.when(F.abs(r) > absolute, error / F.abs(r))
    flat = (F.stddev_pop(r) == 0) | (F.stddev_pop(c) == 0)
    rows = kept(pairs.select("r", "c", rel.alias("_rel")), "metrics")
    rel = F.col("_rel")
    sums = rows.agg(
        F.max(error).alias("max_absolute_error"),
        F.coalesce(F.avg(rel), F.lit(0.0)).alias("mean_relative_error"),
        F.coalesce(F.max(rel), F.lit(0.0)).alias("max_relative_error"),
        F.when(flat, F.when(F.max(error) == 0, 1.0).otherwise(F.lit(float("nan")))).otherwise(F.corr(r, c)).alias("correlation"),
        F.count_if((error > absolute) & (rel.isNull() | (rel > relative))).alias("outside_tolerance"),
        F.count(F.lit(1)).alias("total_values"),
    )
    p99 = percentiles(rows, [], {"_p99": ("_rel", 0.99, "linear")}, buffered)
    return sums.crossJoin(p99).withColumn("p99_relative_error", F.coalesce("_p99", F.lit(0.0))).drop("_p99")  # one row each


def output_stats(pairs: DataFrame, absolute: float, relative: float, buffered: int = BUFFERED) -> DataFrame:
    """Validation of outputs: tolerance is absolute + relative |r|, the 99th percentile is the nearest rank of all values."""
    r, c, error = _difference()
    rel = F.when(F.abs(r) > absolute, error / F.abs(r))
    rows = kept(pairs.select("r", "c", rel.alias("_rel")), "outputs")
    p99 = percentiles(rows, [], {"_p99": ("_rel", 0.99, "nearest")}, buffered)
    return (
        rows.agg(
            F.max(error).alias("max_absolute_error"),
            F.avg(error).alias("mean_absolute_error"),
            F.coalesce(F.max("_rel"), F.lit(0.0)).alias("max_relative_error"),
            F.coalesce(F.avg("_rel"), F.lit(0.0)).alias("mean_relative_error"),
            F.sum(error * error).alias("_d2"),
            F.sum(r * r).alias("_r2"),
            F.count(F.lit(1)).alias("output_count"),
            F.count_if(error > absolute + relative * F.abs(r)).alias("outside_tolerance"),
            F.when(F.stddev_pop(r) * F.stddev_pop(c) > 0, F.corr(r, c)).when(F.max(error) == 0, 1.0).otherwise(0.0).alias("correlation"),
        )
        .withColumn("nrmse", F.sqrt(F.col("_d2") / F.when(F.col("_r2") > 0, F.col("_r2")).otherwise(F.col("output_count").cast("double"))))
        .crossJoin(p99)  # one row each
        .withColumn("p99_relative_error", F.coalesce("_p99", F.lit(0.0)))
        .drop("_d2", "_r2", "_p99")
    )


def difference_stats(pairs: DataFrame, relative: float = 1e-4, absolute: float = 1e-5) -> DataFrame:
    """A value fails only if its difference is above both the absolute and the relative bound."""
    r, _, error = _difference()
    sums = pairs.agg(
        F.max(error).alias("max_abs_diff"),
        F.sqrt(F.avg(error * error)).alias("rms_diff"),
        F.sqrt(F.avg(r * r)).alias("_rms"),
        F.max(error / F.greatest(F.abs(r), F.lit(absolute))).alias("max_rel_error"),
        F.bool_and(~((error > absolute) & (error > relative * r))).alias("passed_tolerance"),
    )
    return sums.withColumn("rel_error", F.when(F.col("_rms") > 0, F.col("rms_diff") / F.col("_rms")).otherwise(0.0)).drop("_rms")


def window_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean power, largest and root mean square difference of each window and engine."""
    _, c, error = _difference()
    return pairs.groupBy(*keys).agg(F.avg(c).alias("mean_power"), F.max(error).alias("max_abs_diff"), F.sqrt(F.avg(error * error)).alias("rms_diff"))


def peak_beam(power: DataFrame) -> DataFrame:
    """The beam with most power in all; of equals, the lowest number."""
    return power.groupBy("b").agg(F.sum("power").alias("total")).orderBy(F.desc("total"), F.asc("b")).limit(1)


def top_beams(power: DataFrame, k: int = 8) -> DataFrame:
    """The k strongest beams, relative to the first."""
    best = power.groupBy("b").agg(F.sum("power").alias("total")).orderBy(F.desc("total"), F.asc("b")).limit(k)
    return best.select("b", "total", F.try_divide("total", F.max("total").over(Window.partitionBy(F.lit(0)))).alias("relative"))  # k rows, and power is made once


def marginals(power: DataFrame) -> DataFrame:
    """Sums by t, by f and by b in one pass: `axis` names the kept column and `at` its value."""
    sets = power.groupingSets([["t"], ["f"], ["b"]], "t", "f", "b").agg(F.sum("power").alias("power"))
    axis = F.when(F.col("t").isNotNull(), "t").when(F.col("f").isNotNull(), "f").otherwise("b")
    return sets.select(axis.alias("axis"), F.coalesce(F.col("t").cast("long"), F.col("f").cast("long"), F.col("b").cast("long")).alias("at"), "power")


def latency_summary(latencies: DataFrame, keys: list[str], buffered: int = BUFFERED) -> DataFrame:
    """Smallest, mean, median, 95th percentile (nearest rank) and largest latency."""
    x = F.col("latency_ms")
    sums = latencies.groupBy(*keys).agg(F.min(x).alias("min_ms"), F.avg(x).alias("mean_ms"), F.max(x).alias("max_ms"))
    return _with(sums, percentiles(latencies, keys, {"median_ms": ("latency_ms", 0.5, "linear"), "p95_ms": ("latency_ms", 0.95, "nearest")}, buffered), keys)


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both summaries of the same groups side by side."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]).drop(*[f"_r_{k}" for k in keys])


def engine_ratios(latencies: DataFrame, baselines: dict[str, str], buffered: int = BUFFERED) -> DataFrame:
    """Latency of each engine (95th percentile linear), and how many times faster than each baseline its median is."""
    x = F.col("latency_ms")
    sums = latencies.groupBy("engine").agg(F.min(x).alias("min_ms"), F.max(x).alias("max_ms"))
    ranks = percentiles(latencies, ["engine"], {"median_ms": ("latency_ms", 0.5, "linear"), "p95_ms": ("latency_ms", 0.95, "linear")}, buffered)
    table = kept(_with(sums, ranks, ["engine"]), "engines")
    for name, engine in baselines.items():
        one = table.where(F.col("engine") == engine).select(F.col("median_ms").alias("_base"))  # one row
        table = table.crossJoin(F.broadcast(one)).withColumn(f"speedup_vs_{name}", F.when(F.col("engine") != engine, F.try_divide("_base", "median_ms"))).drop("_base")
    return table


def timing_groups(timings: DataFrame, fields: list[str], buffered: int = BUFFERED) -> DataFrame:
    """Median and quartiles by problem size, with speedups over the CPU and rates where those fields exist."""
    keys = ["n_ant", "n_freq", "n_beams", "n_time"]
    sums = timings.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n_outputs", "n_cmac", "estimated_flop")], F.count(F.lit(1)).alias("repetitions"))
    shares = {f"{c}_{name}": (c, p, "linear") for c in fields for name, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))}
    out = _with(sums, percentiles(timings, keys, shares, buffered), keys)
    if "cpu_ms" in fields:
        out = out.withColumn("speedup_kernel", F.try_divide("cpu_ms_median", "gpu_kernel_ms_median")).withColumn("speedup_pipeline", F.try_divide("cpu_ms_median", "gpu_pipeline_wall_ms_median"))
    for label, field in (("cpu", "cpu_ms"), ("gpu_kernel", "gpu_kernel_ms"), ("gpu_pipeline", "gpu_pipeline_wall_ms")):
        if field in fields:
            out = out.withColumn(f"{label}_cmac_per_s", F.try_divide(F.col("n_cmac") * 1000.0, F.col(f"{field}_median")))
            out = out.withColumn(f"{label}_flop_per_s", F.try_divide(F.col("estimated_flop") * 1000.0, F.col(f"{field}_median")))
    return out


def for_buffer(records: DataFrame, buffer: str | None, local: int = 336) -> DataFrame:
    """Records of one buffer's channel count; without a buffer, more than one count is an error."""
    if buffer is None:
        kinds = records.agg(F.countDistinct("n_freq").alias("_kinds"))
        checked = kinds.select(F.when(F.col("_kinds") > 1, F.raise_error(F.lit("several channel counts: name a buffer")).cast("int")).otherwise(1).alias("_ok"))
        return records.crossJoin(F.broadcast(checked)).where("_ok = 1").drop("_ok")
    return records.where(F.col("n_freq") == (2 * local if buffer == "both" else local))


def beam_time_matrix(records: DataFrame, n_ant: int, value: str, times: list[int]) -> DataFrame:
    """One row a beam count, one column a time count; the last record of a cell counts."""
    return records.where(F.col("n_ant") == n_ant).groupBy("n_beams").pivot("n_time", times).agg(F.max_by(value, "repeat"))


def positive_limits(values: DataFrame, value: str) -> DataFrame:
    """Smallest and largest positive value, a decade apart where they are equal: limits of a log axis."""
    x = F.col(value)
    lim = values.where((x > 0) & (x < float("inf"))).agg(F.min(x).alias("lower"), F.max(x).alias("upper"))
    return lim.select(F.when(F.col("lower") == F.col("upper"), F.col("upper") / 10).otherwise(F.col("lower")).alias("lower"), "upper")


def joined_directions(true: DataFrame, prior: DataFrame, estimate: DataFrame, keys: tuple[str, ...] = ("w",)) -> DataFrame:
    """Where a source was, was thought to be and was found, side by side by window; windows that one of the three lacks are left out."""
    named = [table.select(*keys, F.col("l").alias(f"l{end}"), F.col("m").alias(f"m{end}")) for table, end in ((true, ""), (prior, "_prior"), (estimate, "_est"))]
    return named[0].join(named[1], list(keys)).join(named[2], list(keys))


def direction_errors(directions: DataFrame) -> DataFrame:
    """Mean distance of prior and estimate from the true direction, and the estimate's in arcminutes."""
    from beamquarry.functions.scalars import lm_distance, pointing_error_arcmin

    true = F.col("l"), F.col("m")
    est = F.col("l_est"), F.col("m_est")
    return directions.agg(
        F.avg(lm_distance(*true, F.col("l_prior"), F.col("m_prior"))).alias("mean_prior_error"),
        F.avg(lm_distance(*true, *est)).alias("mean_error"),
        F.avg(pointing_error_arcmin(*true, *est)).alias("mean_error_arcmin"),
    )


def log_slope(points: DataFrame, x: str, y: str) -> DataFrame:
    """Slope of log y over log x."""
    return points.agg(F.regr_slope(F.log(F.col(y)), F.log(F.col(x))).alias("slope"))


def falls_monotonically(points: DataFrame, order: str, value: str, first: int = 4, slack: float = 0.05) -> DataFrame:
    """Whether the first points, relative to the first of them, never rise by more than the slack."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)  # a handful of points
    norm = F.col(value) / F.greatest(F.first(value).over(w), F.lit(1e-6))
    rows = points.withColumn("_n", norm).withColumn("_i", F.row_number().over(w)).withColumn("_d", F.col("_n") - F.lag("_n").over(w))
    return rows.where(F.col("_i") <= first).agg(F.coalesce(F.bool_and(F.col("_d") <= slack), F.lit(True)).alias("monotonic"))


def records_for(records: DataFrame, **wanted) -> DataFrame:
    """Records whose columns have the wanted values: of one engine and kernel, or of one antenna count."""
    for column, value in wanted.items():
        records = records.where(F.col(column) == value)
    return records


def mean_measurement(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Mean of each field over repetitions."""
    return records.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in fields])
