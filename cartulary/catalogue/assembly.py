"""Assembly of a candidate: releases, memberships, relations, records, image links, source states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.lineage import written
from cartulary.operators.resolve import resolve_facts


def group_releases(observed: DataFrame, value: str, rank: str) -> DataFrame:
    """Releases by (product_id, lineage, region, event_key): release_id and the resolved value."""
    keys = ["product_id", "lineage", "region", "event_key"]
    facts = resolve_facts(observed, keys, value, rank)
    release = F.concat(F.lit("release_"), F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256))
    return facts.withColumn("release_id", release)


def membership_edges(memberships: DataFrame, products: DataFrame, declared: DataFrame) -> DataFrame:
    """kind, from_id, to_id, lineage, origin (declared or derived), once each.

    memberships: printing_id, lineage, kind (product or context), label.  A
    product is the one of that code, else named by a digest of it; a context by
    its lineage and label.  Declared edges (kind, from_id, to_id, lineage)
    stand for equal derived ones.
    """
    by_code = written(products.where("code is not null").groupBy(F.col("code").alias("label")).agg(F.min("product_id").alias("known")))  # so that Spark can split a hot label
    rows = memberships.join(by_code, "label", "left")
    product = F.coalesce("known", F.concat(F.lit("product_"), F.sha2("label", 256)))
    context = F.concat(F.lit("context_"), F.sha2(F.concat_ws("\x1f", "lineage", "label"), 256))
    derived = rows.select("kind", F.col("printing_id").alias("from_id"), F.when(F.col("kind") == "product", product).otherwise(context).alias("to_id"), "lineage", F.lit(1).alias("o"))
    both = derived.unionByName(declared.select("kind", "from_id", "to_id", "lineage", F.lit(0).alias("o")))
    return both.groupBy("kind", "from_id", "to_id", "lineage").agg(F.min("o").alias("o")).withColumn("origin", F.when(F.col("o") == 0, "declared").otherwise("derived")).drop("o")


def shared_artwork(cards: DataFrame) -> DataFrame:
    """Of each art card: the other card of its game with its artwork, if there is exactly one; else why not.

    cards: card_id, game, category, artwork.
    """
    others = written(cards.where("category <> 'art' and artwork is not null").groupBy("game", "artwork").agg(F.count("*").alias("n"), F.min("card_id").alias("other")))
    rows = cards.where("category = 'art'").join(others, ["game", "artwork"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("card_id", F.when(n == 1, F.col("other")).alias("related_id"), F.when(n == 1, "related").when(n == 0, "unrelated").otherwise("ambiguous").alias("outcome"))


def derived_records(products: DataFrame, errata: DataFrame) -> DataFrame:
    """kind, id, parent_id, detail: products with a row for each release, errata with an edge for each lineage.

    products: id, releases (array<struct<id, detail>>); errata: id, target_id, lineages (array).
    """
    p = products.select(F.lit("product").alias("kind"), "id", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("detail"))
    r = products.select(F.lit("release").alias("kind"), "id", F.explode("releases").alias("r")).select("kind", "r.id", F.col("id").alias("parent_id"), F.col("r.detail").alias("detail"))
    e = errata.select(F.lit("erratum").alias("kind"), "id", F.col("target_id").alias("parent_id"), F.lit(None).cast("string").alias("detail"))
    t = errata.select(F.lit("erratum-target").alias("kind"), "id", F.col("target_id").alias("parent_id"), F.explode(F.array_distinct("lineages")).alias("detail"))
    return p.unionByName(r).unionByName(e).unionByName(t)


def printing_projection(edges: DataFrame, absences: DataFrame) -> DataFrame:
    """printing_id and members: the observed edges that curation does not deny, ordered by target and lineage; a printing's are few."""
    kept = edges.join(absences.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return kept.groupBy(F.col("from_id").alias("printing_id")).agg(F.array_sort(F.collect_set(F.struct("to_id", "lineage"))).alias("members"))


def source_states(decisions: DataFrame, authorities: DataFrame, source: str) -> DataFrame:
    """Of each source: state by its last generation, and illegal if an authority is retired or generations are not 1, 2, 3…

    decisions: source, generation, state.
    """
    last = decisions.groupBy(source).agg(F.max_by("state", "generation").alias("state"), F.max("generation").alias("generation"), F.countDistinct("generation").alias("n"), F.count("*").alias("rows"))
    is_authority = authorities.select(source, F.lit(True).alias("a")).distinct()
    broken = (F.col("n") != F.col("generation")) | (F.col("rows") != F.col("n"))
    return last.join(is_authority, source, "left").select(source, "state", "generation", (broken | (F.coalesce("a", F.lit(False)) & (F.col("state") == "retired"))).alias("illegal"))


def image_links(observations: DataFrame, images: DataFrame) -> DataFrame:
    """printing_id and link of the latest opted-in observation, where it has one and no image of the printing exists.

    observations: printing_id, captured_at, observation_id, opted_in, link.
    """
    latest = observations.where("opted_in").groupBy("printing_id").agg(F.max_by(F.struct("link"), F.struct("captured_at", "observation_id")).alias("l"))
    return latest.select("printing_id", "l.link").where("link is not null").join(images.select("printing_id"), "printing_id", "left_anti")


def accepted_unchanged(accepted: DataFrame, current: DataFrame, lineage: str, key: str, digest: str) -> DataFrame:
    """Of each accepted lineage: n_accepted and whether every accepted digest still holds."""
    now = current.groupBy(lineage, key).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    rows = accepted.join(now, [lineage, key], "left")
    holds = F.coalesce((F.col("lo") == F.col(digest)) & (F.col("hi") == F.col(digest)), F.lit(False))
    return rows.groupBy(lineage).agg(F.count("*").alias("n_accepted"), F.min(holds).alias("unchanged"))


def leaf_coverage(leaves: DataFrame, attribute: str, known: Sequence[str]) -> DataFrame:
    """The leaves with consumed: the name at the end of their path, without indexes, is known."""
    name = F.regexp_replace(F.element_at(F.split(attribute, r"\."), -1), r"\[\d+\]", "")
    return leaves.withColumn("consumed", name.isin(*known))


def correct_paragraph(text: Column, before: str, after: str) -> Column:
    """The text with one paragraph replaced; null if it hasn't exactly one such paragraph."""
    parts = F.split(text, "\n")
    n = F.size(F.filter(parts, lambda p: p == F.lit(before)))
    return F.when(n == 1, F.array_join(F.transform(parts, lambda p: F.when(p == F.lit(before), F.lit(after)).otherwise(p)), "\n"))


def byte_range(content: Column, first: Column, last: Column) -> Column:
    """The bytes from first to last (both included, from 0); null if first is beyond the end."""
    size = F.octet_length(content)
    stop = F.least(last, size - 1)
    return F.when((first >= 0) & (first < size) & (stop >= first), F.substring(content, (first + 1).cast("int"), (stop - first + 1).cast("int")))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or the time to an HTTP date (0 if it is past); null for others."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(date.isNotNull(), F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0)))
    return F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("bigint")).otherwise(wait)
