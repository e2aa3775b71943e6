"""What the operators share: byte access to texts, lineage cuts, components.

Texts cross into Python as bytes, in Arrow batches, and are worked through in
slices of a bounded number of bytes; the batches are bounded too, so neither a
worker's memory nor the executor's grows with them.  A document is never split: one longer than the bound is a slice of
its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.operators.lineage import checkpoint_dir as ensure_checkpoint_dir

SLICE_BYTES = 2 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that crosses into Python: two slices.  By Spark's own limits it is 10,000 texts or 64 MB,
#: which the executor's buffers and each worker hold more than once.
BATCH_BYTES = 2 * SLICE_BYTES
#: Edges to a partition while components are sought.
EDGES_PER_PARTITION = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage.

    Once it is written its shuffles are of no more use, so their files go at
    once instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: smaller than a checkpoint, for what is read more than once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator has made, once all that reads it is written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def long_id(df: DataFrame, column: str, name: str = "doc_id"):
    """The column as a long of that name; itself if it is one, so that plans which share it stay the same."""
    if column == name and isinstance(df.schema[column].dataType, T.LongType):
        return F.col(f"`{column}`")
    return F.col(f"`{column}`").cast("bigint").alias(name)


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch holding about limit bytes of text, one row at least."""
    col = batch.column(text)
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless the session has a limit of its own.

    Plans are made when a result is read, so the limit has to stay.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    work: Callable[..., dict[str, Any]],
    fields: list[tuple[str, str]],
    keep: list[str],
    text: str = "text",
    also: str | None = None,
) -> DataFrame:
    """keep, then the columns that work makes of the texts, row for row.

    work gets the texts of one slice as bytes (None for null), and the values
    of the column also if it is given, and returns a list or array for each of
    fields, in order of the rows.
    """
    bound_batches(df.sparkSession)
    keep_fields = [df.schema[c] for c in keep]
    made = [T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields]
    names, schema = [n for n, _ in fields], T.StructType([*keep_fields, *made])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                more = [part.column("__also").to_pylist()] if also else []
                got = work(part.column("__text").to_pylist(), *more)
                cols = [part.column(i) for i in range(len(keep))]
                cols += [x if isinstance(x := got[n], pa.Array) else pa.array(x, type=t) for n, t in zip(names, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    more = [F.col(also).alias("__also")] if also else []
    return df.select(*[F.col(f"`{c}`") for c in keep], *more, F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(run, schema)


def explode_texts(
    df: DataFrame,
    work: Callable[[list[bytes | None], list[pa.Array]], dict[str, Any] | None],
    schema: str | T.StructType,
    ids: list[str],
    text: str = "text",
) -> DataFrame:
    """Any number of rows from each slice: work gets the texts and the columns ids."""
    bound_batches(df.sparkSession)
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [(f.name, to_arrow_type(f.dataType)) for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                got = work(part.column("__text").to_pylist(), [part.column(i) for i in range(len(ids))])
                if got is not None:
                    yield pa.RecordBatch.from_arrays([got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=t) for n, t in arrow], names=[n for n, _ in arrow])

    return df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(run, kinds)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer
    change.  Each step is a minimum by key (combined before the shuffle) and a
    join by key (which Spark can split if a key is hot); no group is gathered.
    Edges with a null end and loops are dropped.
    """
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    edges = cut(edges)

    def size(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        return r[0], r[1] or 0

    before = size(edges)
    while before[0]:
        parts = 1 + before[0] // EDGES_PER_PARTITION
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written apart, so that the joins' sides are plain shuffles, of which Spark can split a hub's.
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts))
        # Large star: each larger neighbour of u is tied to the least of u's surroundings.
        large = cut(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v"))
        # Small star: each smaller neighbour of v, and v itself, is tied to the least of them.
        low = cut(large.groupBy("v").agg(F.min("u").alias("m")).coalesce(parts))
        small = large.join(low, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = cut(small.unionAll(low.select(F.col("m").alias("u"), "v")).distinct().coalesce(parts))
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")).unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
