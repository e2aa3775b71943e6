"""Whether a run's retained requests form a closed graph: a row for each violation.

requests: request_id, lineage, role (surface, listing, detail or image),
surface (of roots), parent_id, partition, first, last (the pages that a listing
request covers), locator (of details), declared, parsed, records.  listed:
request_id, lineage, locator, meaning, a row for each entry of a listing.
required: lineage, surface.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.operators.lineage import written

#: Page numbers of a block: neighbours are looked for within blocks, then between them.
BLOCK = 10_000


def page_faults(pages: DataFrame, keys: list[str], first: str, last: str, block: int = BLOCK) -> DataFrame:
    """keys, kind (page_gap or page_overlap), at: where the ranges of a group leave pages out or cover some twice.

    Equal ranges are one (a page may have been asked for again).  Ranges are
    compared with the furthest end before them, in order of their starts.  A hot
    group is parted into blocks of starts: each block is ordered by itself, and
    the blocks' furthest ends, one row each, are carried on from block to block.
    """
    ranges = pages.select(*keys, F.col(first).alias("lo"), F.col(last).alias("hi")).where("lo is not null and hi is not null").distinct()
    ranges = ranges.withColumn("block", F.floor(F.col("lo") / block))
    within = W.partitionBy(*keys, "block").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    ends = written(ranges.groupBy(*keys, "block").agg(F.max("hi").alias("end")))
    between = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = written(ends.withColumn("carried", F.max("end").over(between)).drop("end"))
    rows = ranges.withColumn("inner", F.max("hi").over(within)).join(carried, [*keys, "block"])
    before = F.greatest("inner", "carried")  # null only for the first range
    kind = F.when(F.col("lo") > before + 1, "page_gap").when(F.col("lo") <= before, "page_overlap")
    return rows.select(*keys, kind.alias("kind"), F.when(kind == "page_gap", before + 1).otherwise(F.col("lo")).alias("at")).where("kind is not null")


def _violation(df: DataFrame, kind: str, subject: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "lineage", subject.cast("string").alias("subject"))


def violations(requests: DataFrame, listed: DataFrame, required: DataFrame, block: int = BLOCK) -> DataFrame:
    """kind, lineage, subject for whatever keeps the graph from being closed.

    Of requests: count_open (what was parsed isn't what was declared),
    root_with_parent, parent_unnamed, parent_missing, image_with_records,
    detail_without_records.  Of listings: page_gap and page_overlap (subject
    partition#page), locator_overlap (entries of several requests that don't
    mean the same), detail_missing (listed but not asked for), detail_unlisted.
    Of roots: surface_missing, surface_unexpected.
    """
    root, subject = F.col("role") == "surface", F.col("request_id")
    out = [
        _violation(requests.where(~F.col("declared").eqNullSafe(F.col("parsed"))), "count_open", subject),
        _violation(requests.where(root & F.col("parent_id").isNotNull()), "root_with_parent", subject),
        _violation(requests.where(~root & F.col("parent_id").isNull()), "parent_unnamed", subject),
        _violation(requests.where((F.col("role") == "image") & (F.col("records") > 0)), "image_with_records", subject),
        _violation(requests.where((F.col("role") == "detail") & (F.coalesce("records", F.lit(0)) == 0)), "detail_without_records", subject),
    ]
    known = written(requests.select(F.col("request_id").alias("parent_id")).distinct())
    out.append(_violation(requests.where(~root & F.col("parent_id").isNotNull()).join(known, "parent_id", "left_anti"), "parent_missing", subject))
    faults = page_faults(requests.where("role = 'listing'"), ["lineage", "partition"], "first", "last", block)
    out.append(faults.select("kind", "lineage", F.concat("partition", F.lit("#"), "at").alias("subject")))
    entries = written(listed.groupBy("lineage", "locator").agg(F.min("request_id").alias("a"), F.max("request_id").alias("b"), F.min("meaning").alias("x"), F.max("meaning").alias("y")))
    out.append(_violation(entries.where("a <> b and x <> y"), "locator_overlap", F.col("locator")))
    details = written(requests.where("role = 'detail' and locator is not null").select("lineage", "locator").distinct())
    out.append(_violation(entries.join(details, ["lineage", "locator"], "left_anti"), "detail_missing", F.col("locator")))
    out.append(_violation(details.join(entries, ["lineage", "locator"], "left_anti"), "detail_unlisted", F.col("locator")))
    roots = written(requests.where(root & F.col("surface").isNotNull()).select("lineage", "surface").distinct())
    wanted = required.select("lineage", "surface").distinct()
    out.append(_violation(wanted.join(roots, ["lineage", "surface"], "left_anti"), "surface_missing", F.col("surface")))
    out.append(_violation(roots.join(wanted, ["lineage", "surface"], "left_anti"), "surface_unexpected", F.col("surface")))
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found
