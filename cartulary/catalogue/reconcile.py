"""Reconciliation: observations and the published state to decisions, warnings and diagnostics.

Every function takes and returns DataFrames; sides are reduced to a row for
each key before they are joined, so common keys make no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.functions.canon import formatting_form
from cartulary.operators.graph import reachable
from cartulary.operators.identity import follow
from cartulary.operators.lineage import tabled, written

#: Fields that make two printings compatible, nulls alike.
COMPATIBLE = ("card_id", "artwork", "printed_digest", "rarity", "treatment")
APPEARANCE = ("card_id", "artwork", "treatment")
CROSS_SOURCE = ("card_id", "printed_digest", "rarity", "treatment")
#: Bounds of the warnings that go with a candidate.
MOST_WARNINGS = 100
MOST_WARNING_BYTES = 65_024


def _sums(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys]).agg(F.count("*").alias(f"{name}_n"), F.min("printing_id").alias(f"{name}_id"))


def _on(keys: Sequence[str], name: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
    return out


def corroborated(observations: DataFrame, printings: DataFrame, seen: DataFrame, members: DataFrame, claims: DataFrame) -> DataFrame:
    """observation_id, kept_id, kept_last: the first and the last compatible printing that may stand for the observation.

    seen: printing_id, lineage.  members: printing_id, product.  claims:
    observation_id, product.  A printing that only other lineages have seen
    counts if the observation claims one of its products; one that its own
    lineage has seen, or none, counts anyway.
    """
    key = F.struct(*COMPATIBLE)  # null fields of structs are alike
    known, asked = printings.select(key.alias("key"), "printing_id"), observations.select(key.alias("key"), "observation_id", "lineage")

    def ends(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy("key", *keys).agg(F.min("printing_id").alias("lo"), F.max("printing_id").alias("hi"))

    # The sides are written apart: small ones are broadcast, and the observations are dealt out once, by their ids.
    by_lineage = tabled(ends(known.join(seen.withColumn("seen", F.lit(True)), "printing_id", "left"), "lineage", "seen"))
    own = by_lineage.where("seen").select("key", "lineage", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    unseen = by_lineage.where("seen is null").select("key", F.col("lo").alias("unseen_lo"), F.col("hi").alias("unseen_hi"))
    shared = tabled(ends(known.join(members, "printing_id"), "product")).select("key", "product", F.col("lo").alias("shared_lo"), F.col("hi").alias("shared_hi"))
    rows = asked.join(claims, "observation_id", "left").join(own, ["key", "lineage"], "left").join(unseen, "key", "left").join(shared, ["key", "product"], "left")
    lo, hi = F.least("own_lo", "unseen_lo", "shared_lo"), F.greatest("own_hi", "unseen_hi", "shared_hi")
    return rows.groupBy("observation_id").agg(F.min(lo).alias("kept_id"), F.max(hi).alias("kept_last")).where("kept_id is not null")


def match_printings(observations: DataFrame, locators: DataFrame, printings: DataFrame, reviews: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """observation_id, printing_id, decision, diagnostic.

    observations: observation_id, lineage, locator, variant, COMPATIBLE,
    artwork_explicit, novel (novelty is proven).  locators: lineage, locator,
    variant, printing_id, one row each.  printings: printing_id, lineage,
    COMPATIBLE.  reviews: observation_id, printing_id.  kept: the result of
    corroborated(), for games in which products corroborate a match; there,
    matches without such a product are insufficient if no other is left, and
    evidence of other lineages alone is not looked for.

    In this order: a known locator (contradictory if its printing is not
    compatible), a review, equal evidence from another lineage only
    (insufficient), a match without explicit artwork (insufficient), several
    (ambiguous), one, and none: a new printing, contradictory if its appearance
    exists, insufficient if its novelty isn't proven.
    """
    owner = printings.select(F.col("printing_id").alias("loc_id"), F.struct(*COMPATIBLE).alias("loc_facts"))
    # Only observations with a locator are looked up; what goes on is narrow, and as few columns as are asked for.
    at = observations.where("locator is not null").join(locators.withColumnRenamed("printing_id", "loc_id"), ["lineage", "locator", "variant"], "left").join(owner, "loc_id", "left")
    facts = ["observation_id", "lineage", *COMPATIBLE, "artwork_explicit", "novel"]
    at = at.select(*facts, "loc_id", F.when(F.col("loc_id").isNotNull(), F.col("loc_facts").eqNullSafe(F.struct(*COMPATIBLE))).alias("agrees"))
    none = observations.where("locator is null").select(*facts, F.lit(None).cast(at.schema["loc_id"].dataType).alias("loc_id"), F.lit(None).cast("boolean").alias("agrees"))
    rows = at.unionAll(none).join(reviews.withColumnRenamed("printing_id", "review_id"), "observation_id", "left")
    exact = _sums(printings, COMPATIBLE, "exact")
    look = _sums(printings, APPEARANCE, "look")
    if kept is not None:
        exact, look = tabled(exact), tabled(look.drop("look_id"))
    # Cross-source evidence comes from another lineage: two lineages at one key always hold one.
    cross = printings.groupBy(*[F.col(k).alias(f"cross_{k}") for k in CROSS_SOURCE]).agg(
        F.min("lineage").alias("cross_lo"), F.max("lineage").alias("cross_hi"), F.min(F.struct("lineage", "printing_id")).alias("cross_first"), F.max(F.struct("lineage", "printing_id")).alias("cross_last")
    )
    rows = rows.join(exact, _on(COMPATIBLE, "exact"), "left").join(look, _on(APPEARANCE, "look"), "left")
    if kept is None:
        rows = rows.join(cross, _on(CROSS_SOURCE, "cross"), "left")
        elsewhere = F.coalesce((F.col("cross_lo") != F.col("lineage")) | (F.col("cross_hi") != F.col("lineage")), F.lit(False))
        other = F.when(F.col("cross_lo") != F.col("lineage"), F.col("cross_first.printing_id")).when(F.col("cross_hi") != F.col("lineage"), F.col("cross_last.printing_id"))
    n = F.coalesce("exact_n", F.lit(0))
    alone = F.lit(False)
    if kept is not None:
        rows = rows.join(kept, "observation_id", "left")
        alone, elsewhere, other = (n > 0) & F.col("kept_id").isNull(), F.lit(False), F.lit(None).cast("string")
        n = F.when(F.col("kept_id").isNull(), 0).when(F.col("kept_id") == F.col("kept_last"), 1).otherwise(2)
    match = "exact_id" if kept is None else "kept_id"
    agrees = F.col("agrees")
    new_id = F.concat(F.lit("printing_"), F.sha2(F.to_json(F.struct(*COMPATIBLE), {"ignoreNullFields": "false"}), 256))
    has = F.col("loc_id").isNotNull()

    contradictory, insufficient = "printing_match_contradictory", "printing_match_insufficient_evidence"
    cases = [
        (has & ~agrees, "loc_id", "located", contradictory),
        (has, "loc_id", "located", None),
        (F.col("review_id").isNotNull(), "review_id", "reviewed", None),
        ((n == 0) & elsewhere, other, "cross_source", insufficient),
        (alone, "exact_id", "uncorroborated", insufficient),
        ((n > 0) & ~F.col("artwork_explicit"), match, "inexplicit", insufficient),
        (n > 1, match, "ambiguous", "printing_match_ambiguous"),
        (n == 1, match, "matched", None),
        (F.col("look_n") > 0, new_id, "allocated", contradictory),
        (~F.col("novel"), new_id, "allocated", insufficient),
        (F.lit(True), new_id, "allocated", None),
    ]

    def first(values: Sequence[Column]) -> Column:
        """By the first case that holds; a column of its own, so that what only another one needs is not carried."""
        return F.coalesce(*[F.when(c, F.struct(v.alias("v"))) for (c, *_), v in zip(cases, values, strict=True)])["v"]

    printing = first([F.col(p) if isinstance(p, str) else p for _, p, _, _ in cases])
    decision, diagnostic = (first([F.lit(case[i]).cast("string") for case in cases]) for i in (2, 3))
    return rows.select("observation_id", printing.alias("printing_id"), decision.alias("decision"), diagnostic.alias("diagnostic"))


def published_conflicts(candidates: DataFrame, published: DataFrame, authorities: DataFrame) -> DataFrame:
    """candidates (card_id, lineage, facts as JSON) with conflict: their facts differ from the published ones beyond formatting.

    Nothing conflicts with a card that is not published, that no authority
    stands behind now, or whose only authority is the candidate's own lineage.
    """
    now = written(authorities.groupBy("card_id").agg(F.min("lineage").alias("__lo"), F.max("lineage").alias("__hi")))  # so that Spark can split a hot card's candidates
    rows = candidates.join(published.select("card_id", F.col("facts").alias("__facts")), "card_id", "left").join(now, "card_id", "left")
    differs = formatting_form(F.col("facts")) != formatting_form(F.col("__facts"))
    others = F.col("__lo").isNotNull() & ~((F.col("__lo") == F.col("lineage")) & (F.col("__hi") == F.col("lineage")))
    return rows.withColumn("conflict", F.coalesce(differs & others, F.lit(False))).drop("__facts", "__lo", "__hi")


def resolve_cards(observations: DataFrame, admissions: DataFrame, published: DataFrame) -> DataFrame:
    """observation_id, card_id, how: by admission, by the published identity, or allocated from the identity (equal ones alike).

    observations: observation_id, game, kind, value; published: game, kind, value, card_id.
    """
    keys = ["game", "kind", "value"]
    known = written(published.groupBy(*keys).agg(F.min("card_id").alias("known_id")))
    rows = observations.join(admissions.select("observation_id", F.col("card_id").alias("admitted_id")), "observation_id", "left").join(known, keys, "left")
    new = F.concat(F.lit("card_"), F.sha2(F.concat_ws("\x1f", *keys), 256))
    how = F.when(F.col("admitted_id").isNotNull(), "admission").when(F.col("known_id").isNotNull(), "published").otherwise("allocated")
    return rows.select("observation_id", F.coalesce("admitted_id", "known_id", new).alias("card_id"), how.alias("how"))


def resolve_with_proof(observations: DataFrame, admissions: DataFrame, published: DataFrame, proofs: DataFrame, reviews: DataFrame) -> DataFrame:
    """observation_id, card_id, how, diagnostic.

    observations: observation_id, game, kind, value (null without an official
    number), facts (a digest), lineage, design.  admissions, reviews:
    observation_id, card_id.  published: card_id, game, kind, value, facts.
    proofs: observation_id, card_id: a printing of the card stands at the
    observation's locator or is compatible with it.

    In this order: an admission, the published identity, the same identity in
    this run (same_run, the first one allocates), and without a number: equal
    facts of one published card without a number that a printing proves, a
    review, unproven (equal facts alone are candidates: the first one is named,
    with a diagnostic), and a new card for each design.
    """
    keys = ["game", "kind", "value"]
    known = written(published.where("kind is not null").groupBy(*keys).agg(F.min("card_id").alias("known_id")))
    equal = written(published.where("kind is null").groupBy("game", "facts").agg(F.min("card_id").alias("equal_id")))
    # A proof is a row of its own, so only the cards that it names are met, not all of equal facts.
    named = proofs.select("observation_id", "card_id").distinct().join(published.where("kind is null").select("card_id", F.col("game").alias("g"), F.col("facts").alias("f")), "card_id")
    rows = observations.withColumn("numbered", F.col("kind").isNotNull() & F.col("value").isNotNull())
    proven = named.join(rows.where(~F.col("numbered")).select("observation_id", "game", "facts"), "observation_id").where("g = game and f = facts")
    proven = written(proven.groupBy("observation_id").agg(F.min("card_id").alias("lo"), F.max("card_id").alias("hi")))
    first = written(rows.where("numbered").groupBy(*keys).agg(F.min("observation_id").alias("first_id")))
    rows = rows.join(admissions.select("observation_id", F.col("card_id").alias("admitted_id")), "observation_id", "left")
    rows = rows.join(reviews.select("observation_id", F.col("card_id").alias("review_id")), "observation_id", "left").join(proven, "observation_id", "left")
    rows = rows.join(known, keys, "left").join(first, keys, "left").join(equal, ["game", "facts"], "left")
    number = F.concat(F.lit("card_"), F.sha2(F.concat_ws("\x1f", *keys), 256))
    design = F.concat(F.lit("card_"), F.sha2(F.concat_ws("\x1f", "game", "lineage", "design"), 256))
    how = (
        F.when(F.col("admitted_id").isNotNull(), "admission")
        .when(F.col("numbered") & F.col("known_id").isNotNull(), "published")
        .when(F.col("numbered") & (F.col("first_id") != F.col("observation_id")), "same_run")
        .when(F.col("numbered"), "allocated")
        .when(F.col("lo") == F.col("hi"), "equal_facts")
        .when(F.col("equal_id").isNotNull() & F.col("review_id").isNotNull(), "reviewed")
        .when(F.col("equal_id").isNotNull(), "unproven")
        .otherwise("allocated")
    )
    rows = rows.withColumn("how", how)
    card = F.when(F.col("how") == "admission", F.col("admitted_id")).when(F.col("how") == "published", F.col("known_id")).when(F.col("numbered"), number)
    card = card.when(F.col("how") == "equal_facts", F.col("lo")).when(F.col("how") == "reviewed", F.col("review_id")).when(F.col("how") == "unproven", F.col("equal_id")).otherwise(design)
    return rows.select("observation_id", card.alias("card_id"), "how", F.when(F.col("how") == "unproven", "canonical_card_conflict").alias("diagnostic"))


def identify_products(observed: DataFrame, prior: DataFrame) -> DataFrame:
    """key, product_id, how: the prior product with the code, else with the name where one side has no code; two of them conflict.

    observed: key, code, name; prior: product_id, code, name.  Names compare in lower case, trimmed.
    """
    named = F.lower(F.trim("name"))
    by_code = written(prior.where("code is not null").groupBy("code").agg(F.count("*").alias("code_n"), F.min("product_id").alias("code_id")))
    p = prior.select("product_id", "code", named.alias("norm"))
    by_name = written(p.groupBy("norm").agg(F.count("*").alias("all_n"), F.min("product_id").alias("all_id"), F.count_if(F.col("code").isNull()).alias("bare_n"), F.min(F.when(F.col("code").isNull(), F.col("product_id"))).alias("bare_id")))
    rows = observed.withColumn("norm", named).join(by_code, "code", "left").join(by_name, "norm", "left")
    # A named match needs a code missing on one side: all of that name without a code here, else the bare ones.
    n = F.coalesce(F.when(F.col("code").isNull(), F.col("all_n")).otherwise(F.col("bare_n")), F.lit(0))
    named_id = F.when(F.col("code").isNull(), F.col("all_id")).otherwise(F.col("bare_id"))
    how = F.when(F.col("code_n") > 1, "conflict").when(F.col("code_n") == 1, "code").when(n > 1, "conflict").when(n == 1, "name").otherwise("new")
    return rows.select("key", F.when(how == "code", F.col("code_id")).when(how == "name", named_id).alias("product_id"), how.alias("how"))


def effective_errata(errata: DataFrame, targets: Sequence[str], at: str, effective: str, erratum_id: str, value: str) -> DataFrame:
    """Of each target the last erratum in force on the date `at`: its id and value, n_in_force, and conflict (other values on its date)."""
    live = errata.where(F.col(effective).isNull() | (F.col(effective) <= F.lit(at))).withColumn("__on", F.coalesce(effective, F.lit("")))
    on_date = live.groupBy(*targets, "__on").agg(F.count("*").alias("n"), F.max_by(F.struct(erratum_id, value), F.col(erratum_id)).alias("last"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    best = on_date.groupBy(*targets).agg(F.sum("n").alias("n_in_force"), F.max_by(F.struct("last", (F.col("lo") != F.col("hi")).alias("conflict")), F.col("__on")).alias("b"))
    return best.select(*targets, "n_in_force", F.col(f"b.last.{erratum_id}").alias(erratum_id), F.col(f"b.last.{value}").alias(value), F.col("b.conflict").alias("conflict"))


def withdrawal_conflicts(assertions: DataFrame, published: DataFrame, entity: str) -> DataFrame:
    """assertions with conflict: reinstated without history, or neither a repeat nor a flip at a later date.

    Both sides: entity, state, effective_at; published has one row for each entity.
    """
    p = published.select(entity, F.col("state").alias("__s"), F.col("effective_at").alias("__e"))
    rows = assertions.join(p, entity, "left")
    known = F.col("__s").isNotNull()
    repeat = (F.col("state") == F.col("__s")) & (F.col("effective_at") == F.col("__e"))
    flip = (F.col("state") != F.col("__s")) & (F.col("effective_at") > F.col("__e"))
    return rows.withColumn("conflict", F.when(known, ~(repeat | flip)).otherwise(F.col("state") == "reinstated")).drop("__s", "__e")


def apply_corrections(entities: DataFrame, redirects: DataFrame, entity_id: str) -> DataFrame:
    """Entities with the id that merges have led to, and whether they were redirected."""
    final = follow(redirects, "retired", "target").select(F.col("retired").alias(entity_id), "final")
    rows = entities.join(final, entity_id, "left")
    return rows.withColumns({"redirected": F.col("final").isNotNull(), entity_id: F.coalesce("final", entity_id)}).drop("final")


def admission_permitted(rows: DataFrame) -> DataFrame:
    """rows with permitted: the owner admits, or the policy is automatic for both kinds of facts and novelty is proven; rejected ones never."""
    automatic = (F.col("policy") == "automatic") & F.col("card_facts") & F.col("printing_details") & F.col("novel")
    return rows.withColumn("permitted", F.coalesce((F.col("decision") == "admit") | (F.col("decision").isNull() & automatic), F.lit(False)))


def coverage_status(planned: DataFrame, observed: DataFrame, lineage: str, request: str, sealed: str) -> DataFrame:
    """Of each lineage: n_planned, n_sealed and complete (all planned requests are observed and sealed)."""
    rows = planned.select(lineage, request).distinct().join(observed.groupBy(lineage, request).agg(F.max(sealed).alias("__s")), [lineage, request], "left")
    return rows.groupBy(lineage).agg(F.count("*").alias("n_planned"), F.count_if(F.coalesce("__s", F.lit(False))).alias("n_sealed")).withColumn("complete", F.col("n_planned") == F.col("n_sealed"))


def partition_completeness(leaves: DataFrame, declared: DataFrame, partition: str, ordinal: str, count: str) -> DataFrame:
    """Of each declared partition: n_leaves, n_distinct, status (complete, missing or duplicated)."""
    each = leaves.groupBy(partition, ordinal).agg(F.count("*").alias("__n"))
    have = each.groupBy(partition).agg(F.sum("__n").alias("n_leaves"), F.count("*").alias("n_distinct"))
    rows = declared.join(have, partition, "left").fillna(0, ["n_leaves", "n_distinct"])
    status = F.when(F.col("n_leaves") > F.col("n_distinct"), "duplicated").when(F.col("n_distinct") == F.col(count), "complete").otherwise("missing")
    return rows.select(partition, count, "n_leaves", "n_distinct", status.alias("status"))


def select_sources(requests: DataFrame, lineage: str) -> DataFrame:
    """Of each lineage, from its requests (participation, failed, is_image): collected, dropped (an optional one has failed) or blocked.

    Image requests may fail.
    """
    failed = F.max(F.col("failed") & ~F.col("is_image"))
    rows = requests.groupBy(lineage).agg(F.count("*").alias("n_requests"), failed.alias("__f"), F.max(F.col("participation") == "required").alias("__r"))
    return rows.select(lineage, "n_requests", F.when(~F.col("__f"), "collected").when(F.col("__r"), "blocked").otherwise("dropped").alias("decision"))


def listing_closure(pages: DataFrame, listing: str, page: str, last: str, locator: str, total: str) -> DataFrame:
    """Of each listing: pages contiguous from 1 to one last page, one declared total, as many distinct locators: closed.

    pages: a row for each locator on each page.
    """
    per_page = pages.groupBy(listing, page).agg(F.max(last).alias("__last"))
    p = per_page.groupBy(listing).agg(F.count("*").alias("n_pages"), F.max(page).alias("__hi"), F.min(page).alias("__lo"), F.count_if(F.col("__last")).alias("__lasts"), F.max(F.when(F.col("__last"), F.col(page))).alias("__end"))
    loc = pages.groupBy(listing, locator).agg(F.min(total).alias("__a"), F.max(total).alias("__b")).groupBy(listing).agg(F.count("*").alias("n_locators"), F.min("__a").alias("__a"), F.max("__b").alias("__b"))
    ok = (F.col("__lo") == 1) & (F.col("__hi") == F.col("n_pages")) & (F.col("__lasts") == 1) & (F.col("__end") == F.col("__hi")) & (F.col("__a") == F.col("__b")) & (F.col("n_locators") == F.col("__a"))
    return p.join(loc, listing).select(listing, "n_pages", "n_locators", F.coalesce(ok, F.lit(False)).alias("closed"))


def warning_summary(warnings: DataFrame, order: Sequence[str], text: str, most: int = MOST_WARNINGS, most_bytes: int = MOST_WARNING_BYTES) -> DataFrame:
    """The first warnings by order, as many as the bounds let, with n_total and truncated; only `most` rows are windowed."""
    total = warnings.agg(F.count("*").alias("n_total"))
    w = W.orderBy(*order)
    first = warnings.select(*order, text).orderBy(*order).limit(most).withColumns({"ordinal": F.row_number().over(w), "__b": F.sum(F.octet_length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))})
    kept = first.where(F.col("__b") <= most_bytes).drop("__b").crossJoin(F.broadcast(total))
    return kept.withColumn("truncated", F.max("ordinal").over(W.partitionBy()) < F.col("n_total"))


def retain_newest(revisions: DataFrame, game: str, order: str, n: int = 3) -> DataFrame:
    """revisions with queryable: the n newest of each game."""
    newest = revisions.select(game, order).distinct().withColumn("__k", F.row_number().over(W.partitionBy(game).orderBy(F.desc(order)))).where(F.col("__k") <= n)
    floor = newest.groupBy(game).agg(F.min(order).alias("__floor"))
    return revisions.join(floor, game).withColumn("queryable", F.col(order) >= F.col("__floor")).drop("__floor")


def unreachable(objects: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """The objects whose key none of the references (their first column) holds."""
    held = None
    for r in references:
        one = r.select(F.col(r.columns[0]).alias(key))
        held = one if held is None else held.unionAll(one)
    return objects.join(held.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def retained(objects: DataFrame, key: str, context: DataFrame, child: str, parent: str, *references: DataFrame) -> DataFrame:
    """objects with retained: a reference (its first column) names the object, or it is a parent, over any number of steps, of one that is named.

    context: child, parent; an object may have many parents, and cycles may occur.
    """
    held = None
    for r in references:
        one = r.select(F.col(r.columns[0]).alias("node"))
        held = one if held is None else held.unionAll(one)
    found = reachable(held, context, child, parent).select(F.col("node").alias(key), F.lit(True).alias("__found"))
    return objects.join(found, key, "left").withColumn("retained", F.coalesce("__found", F.lit(False))).drop("__found")


def text_parts(df: DataFrame, key: str, text: str, length: int = 32_768) -> DataFrame:
    """key, ordinal, part of texts longer than length UTF-16 units; joined in order they are the text.

    A part has length units, or one less where a pair of surrogates would be
    parted.  The text is cut in one pass.
    """
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    # A unit of the pattern is a code point: those beyond the first plane are two units.
    simple = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{length}}}"), F.lit(0))
    plain = ~F.col(text).rlike(r"[\x{10000}-\x{10FFFF}]")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            raw, at, out = (t or "").encode("utf-16-be"), 0, []
            while at < len(raw):
                end = min(at + 2 * length, len(raw))
                if end < len(raw) and 0xD8 <= raw[end - 2] <= 0xDB:  # a pair's first half
                    end -= 2
                out.append(raw[at:end].decode("utf-16-be"))
                at = end
            return out

        return texts.map(one)

    long = df.where(units > length).select(key, text)
    return long.select(key, F.posexplode(F.when(plain, simple).otherwise(cut(F.when(~plain, F.col(text))))).alias("ordinal", "part")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
