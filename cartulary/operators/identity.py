"""Redirect chains and ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written

MOST_STEPS = 32


def follow(redirects: DataFrame, source: str, target: str, most: int = MOST_STEPS) -> DataFrame:
    """source, final, steps for each redirect; fails on a cycle or a chain of more than `most` steps.

    redirects: one target for each source.  The pointers are doubled: a chain
    of n steps takes log n rounds, each a join of what the last one has written
    with itself, until nothing moves.
    """
    now, moved = written(redirects.select(F.col(source).alias("a"), F.col(target).alias("b"), F.lit(1).alias("n"))), True
    for _ in range(most.bit_length()):
        further = now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        nxt = now.join(further, "b", "left")
        now = written(nxt.select("a", F.coalesce("c", "b").alias("b"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.col("c").isNotNull().alias("moved")))
        moved = not now.where("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            break
    bad = F.raise_error(F.concat(F.lit("redirect cycle or chain too long at "), F.col("a").cast("string"))).cast("int")
    return now.select(F.col("a").alias(source), F.col("b").alias("final"), F.when(F.col("n") <= most, F.col("n")).otherwise(bad).alias("steps"))


def ancestors(parents: DataFrame, child: str, parent: str, depth: int) -> DataFrame:
    """child, ancestor, distance up to depth: one join a level, each over the rows that still go on."""
    edges = parents.where(F.col(parent).isNotNull()).select(F.col(child).alias("c"), F.col(parent).alias("p"))
    level = edges.select("c", F.col("p").alias("ancestor"))
    out = level.withColumn("distance", F.lit(1))
    for d in range(2, depth + 1):
        level = level.join(edges.select(F.col("c").alias("ancestor"), F.col("p").alias("next")), "ancestor").select("c", F.col("next").alias("ancestor"))
        out = out.unionAll(level.withColumn("distance", F.lit(d)))
    return out.withColumnRenamed("c", child)


def line(heads: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """head, node, distance: each of heads (their first column) and all that is behind it; fails on a cycle.

    parents: one parent for each child.  Both what is known of each line and the
    pointers double with each round, so n steps take log n rounds.
    """
    jump = written(parents.where(F.col(parent).isNotNull()).select(F.col(child).alias("a"), F.col(parent).alias("b")))
    seen = written(heads.select(F.col(heads.columns[0]).alias("head")).where("head is not null").distinct().select("head", F.col("head").alias("node"), F.lit(0).cast("bigint").alias("distance")))
    step = 1
    while True:
        more = written(seen.join(jump, F.col("node") == F.col("a")).select("head", F.col("b").alias("node"), (F.col("distance") + step).alias("distance")))
        if more.isEmpty():
            return seen
        seen = written(seen.unionAll(more))
        if not seen.groupBy("head", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError("a line of predecessors has a cycle")
        further = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = written(jump.join(further, "b").select("a", F.col("c").alias("b")))
        step *= 2
