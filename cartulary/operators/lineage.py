"""Lineage cuts for plans that loop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where a local session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cartulary-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """df as it is in the shared folder, without the plan that made it."""
    checkpoint_dir(df.sparkSession)
    return df.select("*").checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, where it stays as a checkpoint does: a fraction of a checkpoint's bytes, and of a known size, so that joins may broadcast it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, limit: int = 4 << 20) -> Iterator[None]:
    """While results are made, Arrow batches have at most so many bytes (and a row); by Spark's own limits they hold 10,000 texts or 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
