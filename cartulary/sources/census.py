"""Census of card sets: which sets of an inventory are issued, and do their members add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The English series that were issued as physical products.
PHYSICAL = ["base", "bw", "col", "dp", "ecard", "ex", "gym", "hgss", "lc", "mc", "me", "misc", "neo", "pl", "pop", "sm", "sv", "swsh", "tk", "xy"]


def inventory(sets: DataFrame, excluded: DataFrame) -> DataFrame:
    """sets (set_id, reported, official) with verdict: excluded, candidate, repeated or disagrees.

    excluded lists digital sets in the same columns.  A set that is listed
    twice on either side is repeated; one whose counts differ between the two
    disagrees, as does an excluded one that the inventory lacks.
    """
    here = sets.groupBy("set_id").agg(F.min("reported").alias("reported"), F.min("official").alias("official"), F.count("*").alias("n"))
    there = excluded.groupBy("set_id").agg(F.min("reported").alias("x_reported"), F.min("official").alias("x_official"), F.count("*").alias("x_n"))
    same = F.col("reported").eqNullSafe(F.col("x_reported")) & F.col("official").eqNullSafe(F.col("x_official"))
    verdict = F.when((F.col("n") > 1) | (F.col("x_n") > 1), "repeated").when(F.col("x_n").isNull(), "candidate").when(F.col("n").isNotNull() & same, "excluded").otherwise("disagrees")
    return here.join(there, "set_id", "full").select("set_id", "reported", "official", verdict.alias("verdict"))


def qualify(candidates: DataFrame, details: DataFrame, cards: DataFrame, cutoff: str, physical: Sequence[str] = PHYSICAL) -> DataFrame:
    """set_id, eligibility, reason, enumerated, gap, failed for each detail page of a candidate.

    candidates: set_id, reported, official; details: set_id, series, released
    (text), reported, official; cards: set_id, card_id, local_id.  A page fails
    if its counts are not the inventory's, a card is listed twice or is not
    named by its set and local id, or the cards and the official count do not
    make up the reported one; the other columns are then null.  gap: reported
    cards that are not listed.  A date that is none is unresolved.
    """
    own = F.count_if(~F.coalesce(F.col("card_id") == F.concat_ws("-", "set_id", "local_id"), F.lit(False)))
    counted = cards.groupBy("set_id").agg(F.count("*").alias("enumerated"), F.count_distinct("card_id").alias("ids"), own.alias("foreign"))
    wanted = candidates.select("set_id", F.col("reported").alias("want"), F.col("official").alias("want_official"))
    rows = details.join(wanted, "set_id").join(counted, "set_id", "left").fillna(0, ["enumerated", "ids", "foreign"])
    good = F.col("reported").eqNullSafe(F.col("want")) & F.col("official").eqNullSafe(F.col("want_official"))
    good &= (F.greatest("official", "enumerated") == F.col("reported")) & (F.col("ids") == F.col("enumerated")) & (F.col("foreign") == 0)
    day = F.try_to_date("released", "yyyy-MM-dd")
    reason = F.when(~F.coalesce(F.col("series").isin(*physical), F.lit(False)), "unresolved_series").when(day.isNull(), "unresolved_release_date").when(day > F.lit(cutoff).cast("date"), "not_yet_issued")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("why", reason)
    eligibility = F.when(F.col("why").isNull(), "issued_set_candidate").when(F.col("why") == "not_yet_issued", F.col("why")).otherwise("unresolved")
    gap = F.when(F.col("enumerated") < F.col("reported"), F.col("reported") - F.col("enumerated"))
    kept = {"eligibility": eligibility, "reason": F.col("why"), "enumerated": F.col("enumerated"), "gap": gap}
    return rows.select("set_id", *[F.when(F.col("good"), c).alias(n) for n, c in kept.items()], (~F.col("good")).alias("failed"))
