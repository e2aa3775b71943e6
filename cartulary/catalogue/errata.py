"""Errata: what they correct, who says so, and what they add to those known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written


def identified(parsed: DataFrame, cards: DataFrame, printings: DataFrame) -> DataFrame:
    """parsed with target_id, erratum_id and problem.

    parsed: observation_id, lineage, game, target_type (card or printing), name,
    number (null if the correction gives none), effective_from, wording, value.
    cards: card_id, game, name, number.  printings: observation_id, printing_id,
    the printings that reconciliation has accepted for an observation.

    A card is named by its number, else by its name, in its game, and must be
    one alone (unknown_target, ambiguous_target); a printing is the accepted one
    (printing_not_accepted).  The id is a digest of what the erratum says.
    """
    by_number = written(cards.where("number is not null").groupBy("game", "number").agg(F.count("*").alias("number_n"), F.min("card_id").alias("number_id")))
    by_name = written(cards.groupBy("game", "name").agg(F.count("*").alias("name_n"), F.min("card_id").alias("name_id")))
    accepted = printings.groupBy("observation_id").agg(F.min("printing_id").alias("printing_id"))
    rows = parsed.join(by_number, ["game", "number"], "left").join(by_name, ["game", "name"], "left").join(accepted, "observation_id", "left")
    numbered, printed = F.col("number").isNotNull(), F.col("target_type") == "printing"
    n = F.coalesce(F.when(numbered, F.col("number_n")).otherwise(F.col("name_n")), F.lit(0))
    problem = F.when(printed & F.col("printing_id").isNull(), "printing_not_accepted").when(printed, None).when(n == 0, "unknown_target").when(n > 1, "ambiguous_target")
    target = F.when(problem.isNull(), F.when(printed, F.col("printing_id")).when(numbered, F.col("number_id")).otherwise(F.col("name_id")))
    rows = rows.withColumns({"problem": problem, "target_id": target})
    semantics = F.to_json(F.struct("game", "target_type", "target_id", "effective_from", "wording", "value"), {"ignoreNullFields": "false"})
    erratum = F.when(F.col("problem").isNull(), F.concat(F.lit("erratum_"), F.substring(F.sha2(semantics, 256), 1, 32)))
    return rows.withColumn("erratum_id", erratum).select(*parsed.columns, "target_id", "erratum_id", "problem")


def merged(carried: DataFrame, observed: DataFrame) -> DataFrame:
    """erratum_id, target_id, effective_from, value, lineages, conflict: carried and observed errata, once each.

    Both: erratum_id, target_id, effective_from, wording, value, lineage.  The
    lineages that tell of one are put together; an id under which two things are
    told is a conflict (the smallest is shown).
    """
    said = F.struct("target_id", "effective_from", "wording", "value")
    both = carried.select("erratum_id", said.alias("said"), "lineage").unionByName(observed.select("erratum_id", said.alias("said"), "lineage"))
    sums = both.groupBy("erratum_id").agg(F.min("said").alias("said"), F.max("said").alias("last"), F.array_sort(F.collect_set("lineage")).alias("lineages"))
    return sums.select("erratum_id", "said.target_id", "said.effective_from", "said.value", "lineages", (F.col("said") != F.col("last")).alias("conflict"))
