"""Ordered pages: keyset cursors, row limits and byte budgets."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_ROWS = 100
PAGE_BYTES = 4 << 20


def after(keys: Sequence[str], cursor: Sequence[Any], descending: bool = False) -> Column:
    """Rows that come after cursor in the order of keys, none of them null.

    A row-value comparison; the first key is compared by itself as well, which
    the reader of the files can use.
    """
    row, at = F.struct(*keys), F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor, strict=True)])
    first = F.col(keys[0]) <= F.lit(cursor[0]) if descending else F.col(keys[0]) >= F.lit(cursor[0])
    return first & (row < at if descending else row > at)


def after_nulls_last(keys: Sequence[str], cursor: Sequence[Any]) -> Column:
    """Rows after cursor when nulls sort last in each key."""
    out, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, cursor, strict=True):
        if v is not None:
            out = out | (equal & (F.col(k).isNull() | (F.col(k) > F.lit(v))))
        equal = equal & F.col(k).eqNullSafe(F.lit(v))
    return out


def page(df: DataFrame, order: Sequence[Column], size: Column, limit: int, budget: int = PAGE_BYTES) -> DataFrame:
    """The first rows by order: limit of them at most, and no more than budget bytes, but one row at least.

    Adds ordinal (from 1), page_bytes (running) and has_more (rows are left).
    Only limit + 1 rows reach the windows, whatever the size of df.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    probe = df.orderBy(*order).limit(limit + 1)
    w = W.orderBy(*order)
    rows = probe.withColumns({"ordinal": F.row_number().over(w), "page_bytes": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))})
    fits = (F.col("ordinal") <= limit) & ((F.col("ordinal") == 1) | (F.col("page_bytes") <= budget))
    kept = rows.withColumn("fits", fits)
    return kept.withColumn("has_more", F.max(~F.col("fits")).over(W.partitionBy())).where("fits").drop("fits")


def prefix_sum(df: DataFrame, group: str, order: str, value: Column, block: int, name: str) -> DataFrame:
    """The running sum of value within group by the unique integer order, as column name.

    Sums run within blocks of `block` consecutive orders; the blocks' totals
    are summed up apart and added, so a hot group is parted over many tasks.
    """
    at = df.withColumn("__block", F.floor(F.col(order) / block))
    w = W.partitionBy(group, "__block").orderBy(order)
    inner = at.withColumn("__run", F.sum(value).over(w))
    totals = at.groupBy(group, "__block").agg(F.sum(value).alias("__total"))
    before = W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    joined = inner.join(starts, inner[group].eqNullSafe(starts["__g"]) & (inner["__block"] == starts["__b"]), "left")
    return joined.withColumn(name, F.col("__start") + F.col("__run")).drop("__g", "__b", "__block", "__start", "__run")
