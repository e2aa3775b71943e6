"""Observations as a stream: idempotent intake, freshness, coverage by time window.

The same functions take a batch; on a stream the watermark bounds what is kept
in state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.catalogue.store import Files

#: Folders of a table of observations.
BUCKETS = 64


def read_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files that arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once_each(observations: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """The first observation of each key; repeats within the lateness are dropped.  keys should hold the content's digest."""
    if not observations.isStreaming:
        return observations.dropDuplicates(keys)
    return observations.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def coverage_by_window(observations: DataFrame, lineage: str, at: str, width: str, lateness: str) -> DataFrame:
    """window_start, lineage, n_observations, last_seen; on a stream each window once it is closed."""
    rows = observations.withWatermark(at, lateness) if observations.isStreaming else observations
    counted = rows.groupBy(F.window(at, width).alias("w"), lineage).agg(F.count("*").alias("n_observations"), F.max(at).alias("last_seen"))
    return counted.select(F.col("w.start").alias("window_start"), lineage, "n_observations", "last_seen")


def freshness(observations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest check of each key; on a stream to be written in update mode."""
    return observations.groupBy(*keys).agg(F.max(at).alias("checked_at"), F.count("*").alias("n_observations"))


def append_new(batch: DataFrame, path: str, keys: list[str]) -> int:
    """For foreachBatch: append the rows whose keys the table at path doesn't have; their number.

    The table is parted by a hash of the keys (folders `bucket=…`), of which only
    those that the micro-batch has rows for are read, and there the keys alone.
    Running the same micro-batch again appends nothing.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    new = new.persist()
    if Files(spark, path).exists(path):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        known = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*keys)
        left = new.join(known, keys, "left_anti").persist()
    else:  # the table's first batch
        left = new
    n = left.count()
    if n:
        left.write.mode("append").partitionBy("bucket").parquet(path)
    left.unpersist()
    new.unpersist()
    return n
