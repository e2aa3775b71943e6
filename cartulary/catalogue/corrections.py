"""Identity corrections: merges, splits and assignments, judged, then carried through to what hangs on them.

decisions: sequence, action (merge, split or assign), kind (card or printing),
game, sources and targets (arrays of ids), assignments (printing to card).
cards: id, game, category.  printings: id, card_id.  images: id, printing_id.
edges: id, from_kind, from_id, to_kind, to_id (other kinds always stand).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written

MOST_LINKS = 32


def _entities(cards: DataFrame, printings: DataFrame) -> DataFrame:
    """kind, id, game, card_id, category; a printing has its card's game."""
    of_card = printings.join(cards.select(F.col("id").alias("card_id"), "game"), "card_id", "left")
    none = F.lit(None).cast("string")
    return cards.select(F.lit("card").alias("kind"), "id", "game", none.alias("card_id"), "category").unionByName(of_card.select(F.lit("printing").alias("kind"), "id", "game", "card_id", none.alias("category")))


def problems(decisions: DataFrame, history: DataFrame, cards: DataFrame, printings: DataFrame) -> DataFrame:
    """sequence, code, subject: why a decision can't be applied; none for one that can.

    history: earlier decisions, applied.  An id that an earlier decision (of the
    history or of these, right or wrong) has retired is not chosen again.
    """
    n, m = F.size("sources"), F.size("targets")
    shapes = F.when(F.col("action") == "merge", (n >= 1) & (m == 1)).when(F.col("action") == "split", (n == 1) & (m >= 2)).when(F.col("action") == "assign", (n == 1) & (m == 1) & (F.size("assignments") > 0) & (F.col("kind") == "card"))
    repeated = (F.size(F.array_distinct("sources")) < n) | (F.size(F.array_distinct("targets")) < m) | F.arrays_overlap("sources", "targets")
    fine = F.coalesce(shapes, F.lit(False)) & ~repeated
    card, merge, split, assign = F.col("kind") == "card", F.col("action") == "merge", F.col("action") == "split", F.col("action") == "assign"
    d = written(decisions.withColumn("fine", fine))

    def out(rows: DataFrame, code: str, subject: Column) -> DataFrame:
        return rows.select("sequence", F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    found = [out(d.where(~F.col("fine")), "malformed", F.col("action"))]
    d = d.where("fine")
    # What a decision names must be there, in its game; an assignment's source is retired already.
    chosen = F.when(assign, F.col("targets")).otherwise(F.concat("sources", "targets"))
    named = written(d.select("sequence", "action", "kind", "game", F.explode(chosen).alias("id")))
    entities = _entities(cards, printings).withColumnRenamed("game", "its_game")
    known = written(named.join(entities, ["kind", "id"], "left"))
    found.append(out(known.where("its_game is null"), "unknown_entity", F.col("id")))
    found.append(out(known.where("its_game <> game"), "other_game", F.col("id")))
    merged = known.where(merge).groupBy("sequence", "kind").agg(F.min("card_id").alias("lo"), F.max("card_id").alias("hi"), F.min("category").alias("a"), F.max("category").alias("b"))
    found.append(out(merged.where("kind = 'printing' and lo <> hi"), "printings_of_several_cards", F.col("lo")))
    found.append(out(merged.where("kind = 'card' and a <> b"), "category_differs", F.col("a")))
    retiring = d.where(~assign).select("sequence", "kind", F.explode("sources").alias("id")).unionByName(history.where(~assign).select("sequence", "kind", F.explode("sources").alias("id")))
    first = written(retiring.groupBy("kind", "id").agg(F.min("sequence").alias("first")))
    found.append(out(named.where(~assign).join(first, ["kind", "id"]).where("first < sequence"), "retired_before", F.col("id")))
    # A card's split assigns every printing of the card, to its replacements, and nothing else.
    given = written(d.select("sequence", "action", "kind", F.col("sources")[0].alias("source"), "targets", F.explode("assignments").alias("printing", "card")))
    found.append(out(given.where(merge | ~card), "needless_assignment", F.col("printing")))
    found.append(out(given.where(~merge & card & ~F.array_contains("targets", F.col("card"))), "assigned_elsewhere", F.col("printing")))
    own = printings.select(F.col("id").alias("printing"), F.col("card_id").alias("source"))
    splits = given.where(split & card)
    of_split = d.where(split & card).select("sequence", F.col("sources")[0].alias("source")).join(own, "source")
    found.append(out(of_split.join(splits.select("sequence", "printing"), ["sequence", "printing"], "left_anti"), "printing_unassigned", F.col("printing")))
    found.append(out(splits.join(own, ["printing", "source"], "left_anti"), "foreign_assignment", F.col("printing")))
    # An assignment completes a split that is retained.
    before = history.where(split & card).select(F.col("sources")[0].alias("source"), F.col("targets").alias("into")).select("source", F.explode("into").alias("target")).distinct()
    found.append(out(d.where(assign).select("sequence", F.col("sources")[0].alias("source"), F.col("targets")[0].alias("target")).join(before, ["source", "target"], "left_anti"), "no_split", F.col("source")))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every.distinct()


def moved_printings(decisions: DataFrame, printings: DataFrame) -> DataFrame:
    """id, card_id, now, links for each printing of a retired card: where merges and assignments lead, null if a split names no card for it.

    Each round moves those that still stand at a retired card by one link; only
    they are read again.  Fails on a cycle and on chains of more than MOST_LINKS.
    """
    card = decisions.where("kind = 'card'")
    merges = card.where("action = 'merge'").select(F.explode("sources").alias("now"), F.col("targets")[0].alias("to"))
    splits = card.where("action = 'split'").select(F.col("sources")[0].alias("now"), F.lit(None).cast("string").alias("to"))
    retired = written(merges.unionByName(splits).groupBy("now").agg(F.max("to").alias("to")))
    given = card.where("action in ('split', 'assign')").select("sequence", F.col("sources")[0].alias("now"), F.explode("assignments").alias("id", "card"))
    given = written(given.groupBy("now", "id").agg(F.max_by("card", "sequence").alias("given")))
    moving = written(printings.select("id", "card_id", F.col("card_id").alias("now"), F.lit(0).alias("links")).join(retired.select("now"), "now", "left_semi"))
    done = None
    for _ in range(MOST_LINKS + 1):
        step = moving.join(retired, "now", "left_semi").join(retired, "now").join(given, ["now", "id"], "left")
        step = written(step.select("id", "card_id", F.coalesce("to", "given").alias("now"), (F.col("links") + 1).alias("links")))
        ends = step.join(retired.select("now"), "now", "left_anti")  # nulls stay here
        done = ends.select("id", "card_id", "now", "links") if done is None else written(done.unionByName(ends))
        moving = written(step.join(retired.select("now"), "now", "left_semi"))
        if moving.isEmpty():
            return done.select("id", "card_id", "now", "links")
    raise ValueError("an identity correction chain has a cycle or too many links")


def apply(decisions: DataFrame, cards: DataFrame, printings: DataFrame, images: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, id, outcome, to_id: all that the (faultless) decisions change.

    Cards and printings are retired (to_id: their replacements), printings moved
    to another card or excluded (no card was named), images, edges dropped with
    what they hang on; links dangle if a replacement is not there.
    """
    retired = decisions.where("action <> 'assign'").select("kind", F.explode("sources").alias("id"), F.array_join(F.array_sort("targets"), ",").alias("to_id"), "targets")
    retired = written(retired)
    gone = retired.select("kind", "id").distinct()
    moved = written(moved_printings(decisions, printings))
    lost = moved.where("now is null")
    kept = printings.join(lost, "id", "left_anti").join(gone.where("kind = 'printing'"), "id", "left_anti")
    there = written(cards.select(F.lit("card").alias("kind"), "id").join(gone, ["kind", "id"], "left_anti").unionByName(kept.select(F.lit("printing").alias("kind"), "id")))
    none = F.lit(None).cast("string")
    out = retired.select("kind", "id", F.lit("retired").alias("outcome"), "to_id")
    # A retired printing hangs on no card any more.
    alive = moved.join(gone.where("kind = 'printing'"), "id", "left_anti")
    out = out.unionByName(alive.select(F.lit("printing").alias("kind"), "id", F.when(F.col("now").isNull(), "excluded").otherwise("moved").alias("outcome"), F.col("now").alias("to_id")))
    ids = there.where("kind = 'printing'").select(F.col("id").alias("printing_id"))
    out = out.unionByName(images.join(ids, "printing_id", "left_anti").select(F.lit("image").alias("kind"), "id", F.lit("dropped").alias("outcome"), none.alias("to_id")))
    ends = edges.select("id", F.explode(F.array(F.struct(F.col("from_kind").alias("kind"), F.col("from_id").alias("end")), F.struct(F.col("to_kind").alias("kind"), F.col("to_id").alias("end")))).alias("e")).select("id", "e.*").where("kind in ('card', 'printing')")
    open_ = ends.join(there.withColumnRenamed("id", "end"), ["kind", "end"], "left_anti").select("id").distinct()
    out = out.unionByName(open_.select(F.lit("edge").alias("kind"), "id", F.lit("dropped").alias("outcome"), none.alias("to_id")))
    links = retired.select("kind", F.col("id").alias("source"), F.explode("targets").alias("id")).join(there, ["kind", "id"], "left_anti").join(gone, ["kind", "id"], "left_anti")
    return out.unionByName(links.select("kind", F.col("source").alias("id"), F.lit("dangling").alias("outcome"), F.col("id").alias("to_id")))
