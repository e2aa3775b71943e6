"""What can be reached in a graph whose nodes may have many parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written

#: Rounds after which the nodes found so far are put together in one table.
COMPACT = 16


def reachable(roots: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, round: all nodes that edges lead to from the roots (their first column), and in how many steps at least.

    Semi-naive: each round joins only the nodes that the last one has found with
    the edges and drops what is known, so an edge is followed once.  Rounds are
    written apart; they end when one finds nothing, so cycles do no harm and
    their number is that of the longest shortest path.  Null nodes and edges
    with a null end lead nowhere.
    """
    steps = written(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null and node <> next").distinct())
    new = written(roots.select(F.col(roots.columns[0]).alias("node")).where("node is not null").distinct().withColumn("round", F.lit(0)))
    found: list[DataFrame] = []
    number = 0
    while not new.isEmpty():
        found.append(new)
        if len(found) == COMPACT:
            found = [written(_all(found))]
        number += 1
        # The frontier is distinct by node, so the join gives each edge at most once; a hot node's edges can be split.
        ahead = new.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct()
        new = written(ahead.join(_all(found).select("node"), "node", "left_anti").withColumn("round", F.lit(number)))
    return _all(found) if found else new


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
