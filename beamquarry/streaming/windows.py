"""Streams keyed by sample index: tumbling windows, and the stateful direction tracker.

The sample period is 10/3 microseconds, so real time stamps cannot hold it. A stream's clock is the sample
index itself, written as milliseconds, in which Spark keeps watermarks: a window of N samples is a window of N milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beamquarry.model import SearchConfig
from beamquarry.operators import doa


def with_clock(samples: DataFrame) -> DataFrame:
    return samples.withColumn("clock", F.timestamp_millis(F.col("t")))


def tumbling(samples: DataFrame, spectra: int, keys: tuple[str, ...], value: str = "power", late_samples: int = 0) -> DataFrame:
    """(w, keys, value, n): window sums in append mode; samples later than `late_samples` behind the newest are dropped."""
    clocked = with_clock(samples).withWatermark("clock", f"{late_samples} milliseconds")
    summed = clocked.groupBy(F.window("clock", f"{spectra} milliseconds"), *keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    w = F.floor(F.unix_millis(F.col("window.start")) / spectra).cast("long")
    return summed.select(w.alias("w"), *keys, value, "n")


#: Where keyed state with several variables lives.
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which a processor with named state needs; the session's setting comes back."""
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_PROVIDER, before)


class Tracker(StatefulProcessor):
    """A shard's search: a map of channels to what their memory holds, and the last window with its estimate.

    Of the map only the channels that a batch has are read and written; without forgetting none is.
    """

    def __init__(self, hz: np.ndarray, positions: np.ndarray, config: SearchConfig, column: str):
        self.hz, self.positions, self.config, self.column = hz, positions, config, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.channels = handle.getMapState("channels", "f int", "held binary")
        self.last = handle.getValueState("last", "w long, l double, m double, n double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        decode, scan = doa.scanner(self.column, self.positions, self.config)
        seen, *centre = self.last.get() if self.last.exists() else (-1, None, None, None)
        fresh = pd.concat(list(rows)).sort_values(["w", "f"])
        fresh = fresh[fresh["w"] > seen]
        if not len(fresh):
            return
        centre = np.array(self.config.prior.at(0) if seen < 0 else centre)
        memory, out = doa.Memory(self.config.forgetting), []
        if self.config.forgetting < 1:
            for f in fresh["f"].unique().tolist():
                if self.channels.containsKey((f,)):
                    memory.r[f] = decode(self.channels.getValue((f,))[0])
        for w, group in fresh.groupby("w"):
            fs = group["f"].tolist()
            values = np.stack([memory.update(f, decode(raw)) for f, raw in zip(fs, group[self.column], strict=True)])
            centre, power = doa.search(scan(values, self.hz[fs]), centre, self.config)
            out.append([int(key[0]), int(w), *map(float, centre), float(power)])
        if self.config.forgetting < 1:
            for f, held in memory.r.items():
                self.channels.updateValue((f,), (held.tobytes(),))
        self.last.update((out[-1][1], *out[-1][2:5]))
        yield pd.DataFrame(out, columns=["shard_id", "w", "l", "m", "n", "power"])

    def close(self) -> None:
        pass


def tracked(values: DataFrame, hz: np.ndarray, positions: np.ndarray, config: SearchConfig) -> DataFrame:
    """(shard_id, w, l, m, n, power) of a stream of covariances or lag sums, to be started inside keyed_state().

    Memory and estimate carry over from batch to batch and over a restart, so the rows are those of the search over all at once, if
    windows arrive in order. A window that is not newer than the last one was late and is not searched again.
    """
    hz, positions = np.asarray(hz, float), np.asarray(positions, float)
    config.check(len(positions))
    processor = Tracker(hz, positions, config, "lags" if "lags" in values.columns else "r")
    return values.groupBy("shard_id").transformWithStateInPandas(processor, doa.ESTIMATE, "append", "none")


def batched_windows(power: DataFrame, spectra: int, sink: Callable[[DataFrame, int], None], checkpoint: str, late_samples: int = 0):
    """Whole windows (w, f, power, n), numbered from the stream's start, to a sink, each once; returns the query's writer.

    A window that is not full at the end of a micro-batch stays in the state with what it has, and goes to the sink with the
    batch that fills it. A place (t, f) has one row. What is later than `late_samples` is dropped; the query's progress
    counts it (numRowsDroppedByWatermark).
    """
    sums = tumbling(power, spectra, ("f",), late_samples=late_samples)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch.where(F.col("n") == spectra), batch_id)

    return sums.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that keeps each batch in a folder named by its number: a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def frame_matches(frames: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("frame_id", "shard_id", "dtype", "shape")) -> DataFrame:
    """Frames whose metadata equals what was announced, nulls being equal to nulls."""
    condition = [frames[k].eqNullSafe(expected[k]) for k in keys]
    return frames.join(expected, condition, "left_semi")
