"""Diffs, digests, lifecycle and composition of revisions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators import ordered
from cartulary.operators.lineage import written


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], semantic: Sequence[str], evidence: Sequence[str] = ()) -> DataFrame:
    """keys and change: added, removed, carry_forward, evidence_only or changed."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*semantic).alias(f"{name}_s"), (F.struct(*evidence) if evidence else F.lit(0)).alias(f"{name}_e"))

    both = side(before, "b").join(side(after, "a"), list(keys), "full_outer")
    same, alike = F.col("b_s").eqNullSafe(F.col("a_s")), F.col("b_e").eqNullSafe(F.col("a_e"))
    change = F.when(F.col("b_s").isNull(), "added").when(F.col("a_s").isNull(), "removed").when(same & alike, "carry_forward").when(same, "evidence_only").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that only one of a and b has, with `side`."""
    cols = a.columns
    both = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionByName(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    seen = both.groupBy(*cols).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).where("__a + __b = 1")
    return seen.select(*cols, F.when(F.col("__a") == 1, "left").otherwise("right").alias("side"))


def set_digest(df: DataFrame, group: Sequence[str], order: str, line: Column, block: int) -> DataFrame:
    """The digest of each group's lines in order of the integer `order`, and their number.

    Lines are digested in blocks of `block` consecutive orders, and the blocks'
    digests are folded in order after that: neither a group nor the list of its
    digests is gathered.
    """
    at = df.select(*group, F.floor(F.col(order) / block).alias("__block"), F.col(order).alias("__o"), line.alias("__line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__line"))), lambda x: x["__line"]), "\n")
    blocks = at.groupBy(*group, "__block").agg(F.sha2(text, 256).alias("__d"), F.count("*").alias("__n"))

    def step(state, digest, n):
        state[0].update(f"\n{digest}".encode() if state[1] else digest.encode())
        return state[0], state[1] + n

    return ordered.fold(blocks, group, ["__block"], ["__d", "__n"], lambda: (hashlib.sha256(), 0), step, lambda s: (s[1], s[0].hexdigest()), "n_rows bigint, digest string")


def replace_group(composition: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """The composition with the groups that fresh has taken from fresh alone."""
    return composition.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh)


def lifecycle(entities: DataFrame, observations: DataFrame, key: str, at: str) -> DataFrame:
    """Each entity with first_seen, last_seen and n_seen; null and 0 if it never was."""
    seen = observations.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n_seen"))
    return entities.join(seen, key, "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))


def carry_lifecycle(prior: DataFrame, seen: DataFrame, key: str, revision: str) -> DataFrame:
    """prior (key, first, last) and this revision's seen keys to the next lifecycle, with withdrawn."""
    both = prior.join(seen.select(key, F.lit(True).alias("__seen")).distinct(), key, "full_outer")
    return both.select(key, F.coalesce("first", F.lit(revision)).alias("first"), F.when(F.col("__seen"), F.lit(revision)).otherwise(F.col("last")).alias("last"), F.coalesce(~F.col("__seen"), F.lit(True)).alias("withdrawn"))


def disappeared(prior: DataFrame, observed: DataFrame, checked: DataFrame, keys: Sequence[str], lineage: str) -> DataFrame:
    """Prior rows of checked lineages that are not observed any more."""
    return prior.join(checked.select(lineage).distinct(), lineage, "left_semi").join(observed.select(*keys, lineage).distinct(), [*keys, lineage], "left_anti")


def coverage_change(before: DataFrame, after: DataFrame, key: str, count: str) -> DataFrame:
    """key, previous, current, threshold, verdict: a loss at the threshold blocks, a gain there warns."""
    joined = before.select(key, F.col(count).alias("previous")).join(after.select(key, F.col(count).alias("current")), key, "full_outer")
    rows = joined.select(key, F.coalesce("previous", F.lit(0)).alias("previous"), F.coalesce("current", F.lit(0)).alias("current"))
    rows = rows.withColumn("threshold", F.greatest(F.lit(25), F.ceil(F.col("previous") * 2 / 10)).cast("bigint"))
    lost = F.col("previous") - F.col("current")
    return rows.withColumn("verdict", F.when(lost >= F.col("threshold"), "blocked").when(-lost >= F.col("threshold"), "warned").otherwise("accepted"))


def extend_history(prior: DataFrame, now: DataFrame, keys: Sequence[str], fact: str, revision: int) -> DataFrame:
    """keys, fact, first_revision, last_revision, current, missing: the spans of prior with those of one more revision.

    prior: the same columns, in which an entity has one current span for each
    fact that holds.  now: keys and fact, what holds in `revision`.  A fact that
    still holds goes on; one that doesn't ends; one that holds (again) begins a
    span.  An entity of which nothing holds any more has a missing span, without
    a fact, which goes on until something does.
    """
    held = now.select(*keys, fact).where(F.col(fact).isNotNull()).distinct()
    present = written(held.select(*keys).distinct())
    at = F.lit(revision).cast("bigint")
    open_ = prior.where("current and not missing").join(held, [*keys, fact], "left_semi").select(*keys, fact)
    open_ = written(open_.withColumn("__goes", F.lit(True)))
    spans = prior.where("not missing").join(open_, [*keys, fact], "left")
    goes = F.col("current") & F.coalesce("__goes", F.lit(False))
    spans = spans.select(*keys, fact, "first_revision", F.when(goes, at).otherwise(F.col("last_revision")).alias("last_revision"), goes.alias("current"), "missing")
    begun = held.join(open_, [*keys, fact], "left_anti").select(*keys, fact, at.alias("first_revision"), at.alias("last_revision"), F.lit(True).alias("current"), F.lit(False).alias("missing"))
    absent = prior.select(*keys).distinct().join(present, list(keys), "left_anti").withColumn("__absent", F.lit(True))
    absent = written(absent)
    gaps = prior.where("missing").join(absent, list(keys), "left")
    still = F.col("current") & F.coalesce("__absent", F.lit(False))
    gaps = gaps.select(*keys, fact, "first_revision", F.when(still, at).otherwise(F.col("last_revision")).alias("last_revision"), still.alias("current"), "missing")
    none = F.lit(None).cast(prior.schema[fact].dataType).alias(fact)
    new = absent.select(*keys).join(prior.where("missing and current"), list(keys), "left_anti").select(*keys, none, at.alias("first_revision"), at.alias("last_revision"), F.lit(True).alias("current"), F.lit(True).alias("missing"))
    return spans.unionByName(begun).unionByName(gaps).unionByName(new)
