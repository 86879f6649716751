"""Shared pieces of the text-corpus operators: words, scratch tables, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamquarry.session import scratch_path

#: A word is a run of characters other than space and \t \n \v \f \r.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: A side of a join is broadcast only if its stored size was measured to be no larger; in memory that is about eight times as much.
BROADCAST_BYTES = 8 << 20


#: Spark drops the shuffle files of a write when it ends with this set: nothing reads them again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors don't matter."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a table made by stored(), by the file system's own count."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def bounded_broadcast(df: DataFrame, measured: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of df, some rows and columns of the stored table `measured`, if that is no larger than the limit.

    Else the join is left to shuffle.
    """
    return F.broadcast(df) if stored_bytes(measured) <= limit else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, hot_share: int = 1000, least: int = 2) -> DataFrame:
    """Inner join of stored rows with a table of distinct keys that says how many rows each key has.

    Keys of more than one in hot_share of all rows are fewer than hot_share, so they are broadcast and their
    rows stay where they are; the rest is shuffled, and no key of it is large.
    """
    least = max(2, least, total // hot_share)
    hot, cold = table.where(F.col(count) >= least), table.where(F.col(count) < least)
    here = rows.join(F.broadcast(hot), key)
    there = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return here.unionByName(there)


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches of texts in slices, so that few texts at a time become Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
