"""Which sources a run goes by: outages, designated authorities, and what is proven unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.identity import line
from cartulary.operators.lineage import written
from cartulary.operators.resolve import latest

AREA = ["game", "area", "locale", "region"]


def missing_authorities(decisions: DataFrame, plans: DataFrame) -> DataFrame:
    """AREA, lineage, applicable: designated authorities that no plan collects though others collect in their area.

    decisions: AREA, lineage, sequence; the last one of an area stands.  plans:
    lineage, game, locale, region, areas (array).  An area that no plan touches
    misses nobody.
    """
    standing = latest(decisions, AREA, ["sequence"]).select(*AREA, F.col("lineage").alias("authority"))
    each = plans.select("lineage", "game", F.explode("areas").alias("area"), "locale", "region")
    collected = written(each.groupBy(*AREA).agg(F.array_sort(F.collect_set("lineage")).alias("applicable")))
    found = standing.join(collected, AREA).where(~F.array_contains("applicable", F.col("authority")))
    return found.select(*AREA, F.col("authority").alias("lineage"), "applicable")


def unchanged_lineages(candidates: DataFrame, heads: DataFrame, selections: DataFrame, current: DataFrame) -> DataFrame:
    """game, lineage, adapter, accepted_in, n_accepted, unchanged: does the evidence of each current lineage equal the last accepted one?

    candidates: id, game, predecessor.  heads: id, the run's own candidate of
    each game; the walk begins behind it and goes back, over candidates that
    have nothing of a lineage, to the nearest one that has.  selections:
    candidate, lineage, adapter, request_id, role, digest.  current: game,
    lineage, adapter, request_id, role, digest.  Images don't count.  Unchanged:
    the same requests with the same digests, by the same adapter.
    """
    walk = line(heads, candidates, "id", "predecessor").where("distance > 0").select(F.col("node").alias("candidate"), F.col("distance").alias("round"))
    own = candidates.select(F.col("id").alias("candidate"), "game").join(walk, "candidate")
    facts = selections.where("role <> 'image'").join(written(own), "candidate")
    near = written(facts.groupBy("game", "lineage").agg(F.min(F.struct("round", "candidate")).alias("n")).select("game", "lineage", F.col("n.candidate").alias("candidate")))
    accepted = facts.join(near, ["game", "lineage", "candidate"]).select("game", "lineage", "candidate", "request_id", F.col("adapter").alias("old_adapter"), F.col("digest").alias("old"))
    now = current.where("role <> 'image'").select("game", "lineage", "request_id", "adapter", "digest")
    both = accepted.join(now, ["game", "lineage", "request_id"], "full")
    same = F.col("old").eqNullSafe(F.col("digest")) & F.col("old_adapter").eqNullSafe(F.col("adapter"))
    sums = both.groupBy("game", "lineage").agg(F.max("adapter").alias("adapter"), F.max("candidate").alias("accepted_in"), F.count("old_adapter").alias("n_accepted"), F.min(same).alias("same"))
    return sums.where("adapter is not null").select("game", "lineage", "adapter", "accepted_in", "n_accepted", (F.col("same") & (F.col("n_accepted") > 0)).alias("unchanged"))


def selected_sources(requests: DataFrame, plans: DataFrame, decisions: DataFrame, unchanged: DataFrame) -> DataFrame:
    """kind, subject, outcome: of each lineage whether it is collected, omitted or blocked, and each authority that is missed.

    requests: lineage, role, state, code; a failed one fails its lineage, unless
    it is an image.  plans: lineage, participation (required or optional), game,
    locale, region, areas.  An optional lineage with an outage is omitted as a
    whole, and blocked if it has another failure too.  A designated authority
    that is not collected blocks its area unless all lineages that are collected
    there are proven unchanged (lineage, unchanged).
    """
    failed = (F.col("state") == "failed") & (F.col("role") != "image")
    outage = F.coalesce(F.col("code").isin(*OUTAGES), F.lit(False))
    sums = written(requests.groupBy("lineage").agg(F.max(failed & outage).alias("out"), F.max(failed & ~outage).alias("bad")))
    rows = plans.join(sums, "lineage", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("out", "bad")})
    optional = F.col("participation") == "optional"
    outcome = F.when(optional & F.col("out") & ~F.col("bad"), "omitted").when(F.col("out") | F.col("bad"), "blocked").otherwise("collected")
    judged = written(rows.withColumn("outcome", outcome))
    kept = judged.where(~(optional & F.col("out")))
    absent = missing_authorities(decisions, kept.select("lineage", "game", "locale", "region", "areas"))
    proven = unchanged.where("unchanged").select(F.col("lineage").alias("one")).distinct().withColumn("proven", F.lit(True))
    each = absent.select(*AREA, "lineage", F.explode("applicable").alias("one")).join(proven, "one", "left")
    areas = each.groupBy(*AREA, "lineage").agg(F.min(F.coalesce("proven", F.lit(False))).alias("all_proven"))
    missing = areas.select(F.lit("authority").alias("kind"), F.concat_ws("/", *AREA, "lineage").alias("subject"), F.when(F.col("all_proven"), "unchanged").otherwise("missing").alias("outcome"))
    return judged.select(F.lit("lineage").alias("kind"), F.col("lineage").alias("subject"), "outcome").unionAll(missing)


# Failures that are outages of a source.
OUTAGES = ("timeout", "unavailable", "rate_limited")
