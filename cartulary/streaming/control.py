"""State transitions, deadlines, budgets and selection, as windows over event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.operators.keyset import prefix_sum


def transitions(events: DataFrame, key: str, order: Sequence[str], state: str, legal: Sequence[tuple[str, str]]) -> DataFrame:
    """The events after a key's first one, with from_state, to_state and whether the step is illegal."""
    w = W.partitionBy(key).orderBy(*order)
    steps = events.withColumns({"from_state": F.lag(state).over(w), "to_state": F.col(state)}).where("from_state is not null")
    ok = F.concat_ws(" ", "from_state", "to_state").isin(*[f"{a} {b}" for a, b in legal])
    return steps.withColumn("illegal", ~ok)


def current(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """An event log folded into its current row: of each column the last value that is not null."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def stalled(rows: DataFrame, deadlines: Sequence[str], now: str, grace: str) -> DataFrame:
    """deadline (the latest of the deadlines that are set, and the grace) and whether now is beyond it."""
    at = F.greatest(*deadlines) if len(deadlines) > 1 else F.col(deadlines[0])
    return rows.withColumn("deadline", at + F.expr(grace)).withColumn("stalled", F.col("deadline") < F.col(now))


def admit(rows: DataFrame, group: str, order: str, cost: Column, cap: int, block: int = 1 << 16) -> DataFrame:
    """charged (the running cost of the group) and admitted (it is within cap)."""
    return prefix_sum(rows, group, order, cost, block, "charged").withColumn("admitted", F.col("charged") <= cap)


def select_first(rows: DataFrame, group: str, order: str, groups: Sequence[str], most: int) -> DataFrame:
    """The rows with decision: out_of_group, selected (the first `most` of a group by order) or deferred.

    The order of a group's last selected row is found by a bounded top list
    for each task and group, so no group is sorted whole.
    """
    inside = rows.where(F.col(group).isin(*groups))
    w = W.partitionBy(group).orderBy(order)
    last = inside.select(group, order).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).groupBy(group).agg(F.max(order).alias("__last"))
    joined = rows.join(F.broadcast(last), group, "left")  # a row for each of the named groups
    decision = F.when(~F.coalesce(F.col(group).isin(*groups), F.lit(False)), "out_of_group").when(F.col(order) <= F.col("__last"), "selected").otherwise("deferred")
    return joined.withColumn("decision", decision).drop("__last")


def capacity(requests: DataFrame, lineage: str, request: str, most: int) -> DataFrame:
    """n_requests (distinct) of each lineage and whether they are within its capacity."""
    each = requests.select(lineage, request).distinct()
    return each.groupBy(lineage).agg(F.count(request).alias("n_requests")).withColumn("within_capacity", F.col("n_requests") <= most)
