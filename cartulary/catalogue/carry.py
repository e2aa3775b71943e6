"""Carry-forward: the published state and what this run has observed, put together by checked lineages.

A lineage that the run has checked speaks for itself: what it no longer shows is
gone from its side.  One that was not checked keeps all that it has said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written


def _preserved(prior: DataFrame, checked: DataFrame) -> DataFrame:
    return prior.join(checked.select("game", "lineage").distinct(), ["game", "lineage"], "left_anti")


def products(prior: DataFrame, observed: DataFrame, checked: DataFrame, ranks: DataFrame, state: DataFrame) -> DataFrame:
    """game, product_id, name, observed, lineages, missed.

    prior, observed: game, product_id, lineage, name, one row for each lineage.
    checked: game, lineage.  ranks: lineage, rank (lower speaks first).  state:
    game, product_id, name as published.  A product speaks by its best ranked
    lineage among the preserved and the observed ones; one that nothing speaks
    for any more stays as it was published, not observed.  missed: the checked
    lineages that had it and have it no longer, null where the run observes it
    or in games that it has no product of.
    """
    rows = _preserved(prior, checked).select("game", "product_id", "lineage", "name", F.lit(False).alias("now"))
    rows = rows.unionByName(observed.select("game", "product_id", "lineage", "name", F.lit(True).alias("now")))
    ranked = rows.join(ranks, "lineage", "left")
    best = F.min_by("name", F.struct(F.coalesce("rank", F.lit(1 << 30)), "lineage", ~F.col("now"), "name")).alias("spoken")
    spoken = written(ranked.groupBy("game", "product_id").agg(best, F.max("now").alias("observed"), F.array_sort(F.collect_set("lineage")).alias("lineages")))
    seen = observed.select("game").distinct().withColumn("surface", F.lit(True))
    gone = written(prior.join(checked.select("game", "lineage").distinct(), ["game", "lineage"], "left_semi").groupBy("game", "product_id").agg(F.array_sort(F.collect_set("lineage")).alias("missed")))
    every = state.select("game", "product_id", "name").join(spoken, ["game", "product_id"], "full").join(gone, ["game", "product_id"], "left").join(F.broadcast(seen), "game", "left")
    now = F.coalesce("observed", F.lit(False))
    return every.select(
        "game", "product_id", F.coalesce("spoken", "name").alias("name"), now.alias("observed"), F.coalesce("lineages", F.array().cast("array<string>")).alias("lineages"),
        F.when(~now & F.col("surface") & F.col("name").isNotNull(), F.col("missed")).alias("missed"),
    )


def contexts(prior: DataFrame, observed: DataFrame, checked: DataFrame) -> DataFrame:
    """game, context_id, observed, lineages: where products were handed out.

    prior: game, context_id, observed, lineages (null: never told by lineage; it
    stays as it is in games the run shows nothing of).  observed: game,
    context_id, lineage.
    """
    shown = checked.groupBy("game").agg(F.collect_set("lineage").alias("gone"))
    now = observed.groupBy("game", "context_id").agg(F.array_sort(F.collect_set("lineage")).alias("new"))
    rows = prior.join(F.broadcast(shown), "game", "left").join(written(now), ["game", "context_id"], "full")
    left = F.when(F.col("gone").isNull(), F.col("lineages")).otherwise(F.array_except("lineages", "gone"))
    lineages = F.when(left.isNull() & F.col("new").isNull(), F.lit(None)).otherwise(F.array_sort(F.array_union(F.coalesce(left, F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>")))))
    untold = F.col("lineages").isNull() | F.col("gone").isNull()
    kept = F.when(untold, F.coalesce("observed", F.lit(False))).otherwise(F.size(left) > 0)
    return rows.select("game", "context_id", (F.col("new").isNotNull() | kept).alias("observed"), lineages.alias("lineages"))


def edges(prior: DataFrame, observed: DataFrame, checked: DataFrame) -> DataFrame:
    """game, edge_id, lineage, label, observed: relationships of products.

    prior: game, edge_id, lineage, label, observed, category; curated ones are
    left out (they are laid over the result again).  observed: game, edge_id,
    lineage, label.  An edge of a checked lineage is what the run observes, or
    stays with observed = false; that of another lineage stays and hides an
    observation with its id.
    """
    told = checked.select("game", "lineage").distinct().withColumn("checked", F.lit(True))
    before = prior.where("category is null or category <> 'curated'").join(F.broadcast(told), ["game", "lineage"], "left")
    is_checked = F.coalesce("checked", F.lit(False))
    old = before.select("game", "edge_id", F.struct("lineage", "label", F.when(is_checked, False).otherwise(F.col("observed")).alias("observed")).alias("old"), is_checked.alias("told"))
    new = observed.groupBy("game", "edge_id").agg(F.min(F.struct("lineage", "label", F.lit(True).alias("observed"))).alias("new"))
    both = old.join(written(new), ["game", "edge_id"], "full")
    pick = F.when(F.col("old").isNull() | (F.col("told") & F.col("new").isNotNull()), F.col("new")).otherwise(F.col("old"))
    return both.select("game", "edge_id", pick.alias("e")).select("game", "edge_id", "e.*")


def scoped_disappearance(published: DataFrame, observed: DataFrame, located: DataFrame, scopes: DataFrame) -> DataFrame:
    """printing_id, lineages: published printings that this run has not observed though these lineages were checked for their card and have shown them.

    published: printing_id, game, kind, value (the card's official identity).
    observed: printing_id.  located: printing_id, lineage (locator evidence).
    scopes: game, kind, value, lineage: the identities that a lineage has declared as checked.
    """
    missing = published.join(observed.select("printing_id").distinct(), "printing_id", "left_anti")
    declared = written(scopes.groupBy("game", "kind", "value").agg(F.collect_set("lineage").alias("declared")))
    shown = written(located.groupBy("printing_id").agg(F.collect_set("lineage").alias("shown")))
    rows = missing.join(declared, ["game", "kind", "value"]).join(shown, "printing_id")
    return rows.select("printing_id", F.array_sort(F.array_intersect("declared", "shown")).alias("lineages")).where(F.size("lineages") > 0)
