"""The log of decisions on proposed entities, and what a publisher confirms of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import ordered

#: Actions that are legal in each state of a proposal, and the state that they lead to.
STEPS = {
    "unresolved": {"admit": "admitted", "link": "admitted", "reject": "rejected", "reconsider": "unresolved"},
    "rejected": {"reject": "rejected", "reconsider": "unresolved"},
    "admitted": {"reconsider": "unresolved"},
}


def decide(log: DataFrame) -> DataFrame:
    """proposal_id, seq, outcome, generation, status: each request of the log after the ones before it.

    log: proposal_id, seq, action, expected (the generation that the owner has
    seen), key (of the request, so that it may be sent again), content.  A
    decision counts only if it names the generation that stands, so of two that
    were made at the same sight the second one is a lost_update; one that the
    state doesn't allow is an illegal_step; content may only come with
    reconsider (else misplaced_content).  A request that is sent again with the
    same key is a replay, with another request under the key a conflict.  Only
    applied ones make a generation.
    """

    def step(state: tuple, seq: int, action: str, expected: int, key: str, content: str) -> tuple[tuple, list[tuple]]:
        generation, status, keys = state
        request = (action, expected, content)
        if key is not None and key in keys:
            outcome = "replay" if keys[key] == request else "conflict"
        elif expected is None or expected != generation:
            outcome = "lost_update"
        elif action not in STEPS[status]:
            outcome = "illegal_step"
        elif content is not None and action != "reconsider":
            outcome = "misplaced_content"
        else:
            outcome, generation, status = "applied", generation + 1, STEPS[status][action]
            if key is not None:
                keys = {**keys, key: request}
        return (generation, status, keys), [(seq, outcome, generation, status)]

    plain = log.select("proposal_id", F.col("seq").cast("bigint").alias("seq"), "action", F.col("expected").cast("bigint").alias("expected"), F.col("key").cast("string").alias("key"), F.col("content").cast("string").alias("content"))
    begin: Any = (0, "unresolved", {})
    return ordered.scan(plain, ["proposal_id"], ["seq"], ["seq", "action", "expected", "key", "content"], lambda: begin, step, lambda state: [], "seq bigint, outcome string, generation bigint, status string")


def confirmed_fields(observed: DataFrame, accepted: DataFrame, publishers: DataFrame) -> DataFrame:
    """observed without its fields, confirmed, differing: the fields of a publisher's evidence that the accepted record has alike, or otherwise.

    observed: entity_id, lineage, fields (map of path to JSON value); accepted:
    entity_id, fields, one row each; publishers: lineage.  Null evidence says
    nothing, nor does evidence on fields that the record lacks.
    """
    rows = observed.join(F.broadcast(publishers.select("lineage").distinct()), "lineage", "left_semi").join(accepted.select("entity_id", F.col("fields").alias("known")), "entity_id")
    said = F.filter(F.map_entries("fields"), lambda e: e["value"].isNotNull() & (e["value"] != "null") & F.map_contains_key("known", e["key"]))
    rows = rows.withColumn("said", said)

    def names(alike: bool):
        own = F.filter("said", lambda e: F.element_at("known", e["key"]).eqNullSafe(e["value"]) if alike else ~F.element_at("known", e["key"]).eqNullSafe(e["value"]))
        return F.array_sort(F.transform(own, lambda e: e["key"]))

    return rows.select(*[c for c in observed.columns if c != "fields"], names(True).alias("confirmed"), names(False).alias("differing"))
