"""Entity and conflict resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_facts(df: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """A fact for each key: n_values, value (of the best rank), conflict (two values at that rank), disagreements.

    A null is no value: it neither wins nor conflicts, and a key with nulls
    alone has none.  Two aggregations that combine before the shuffle: first
    the distinct values with their best rank, then the best of them.
    """
    values = df.groupBy(*keys, value).agg(F.min(rank).alias("__rank"))
    known = F.col(value).isNotNull()
    best = values.groupBy(*keys).agg(
        F.count(value).alias("n_values"),
        F.min(F.when(known, F.struct("__rank", value))).alias("__lo"),
        # The largest value at the best rank: ranks are negated so that the best one is the greatest.
        F.max(F.when(known, F.struct((-F.col("__rank")).alias("r"), F.col(value).alias("v")))).alias("__hi"),
    )
    conflict = F.coalesce(F.col(f"__lo.{value}") != F.col("__hi.v"), F.lit(False))
    others = F.greatest(F.col("n_values") - 1, F.lit(0))
    return best.select(*keys, "n_values", F.col(f"__lo.{value}").alias("value"), conflict.alias("conflict"), others.alias("disagreements"))


def disagreeing(df: DataFrame, keys: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Keys whose facts take more than one combination of values: n_facts and the first combination."""
    values = df.select(*keys, *facts).distinct()
    return values.groupBy(*keys).agg(F.count("*").alias("n_facts"), F.min(F.struct(*facts)).alias("first_fact")).where("n_facts > 1")


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row by order, and whether it stands before others (superseded_others)."""
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c for c in df.columns if c not in keys]).alias("row"))).alias("b")
    return df.groupBy(*keys).agg(best, F.count("*").alias("n")).select(*keys, "b.row.*", (F.col("n") > 1).alias("superseded_others"))


def fill_by_rank(df: DataFrame, keys: Sequence[str], rank: str, columns: Sequence[str]) -> DataFrame:
    """Of each key and column the value of the best rank that has one: a retained source, its gaps filled by the next."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in columns], F.min(rank).alias("retained_rank"))


def cross_source_same(df: DataFrame, keys: Sequence[str], lineage: str, entity: str) -> DataFrame:
    """Keys that several lineages share: n_lineages, n_entities and the least entity, candidates for one identity."""
    each = df.groupBy(*keys, lineage).agg(F.min(entity).alias("__e"), F.max(entity).alias("__f"))
    rows = each.groupBy(*keys).agg(F.count("*").alias("n_lineages"), F.min("__e").alias("first_entity"), F.max("__f").alias("__last"))
    return rows.where("n_lineages > 1").withColumn("agree", F.col("first_entity") == F.col("__last")).drop("__last")


def compatible(candidates: DataFrame, published: DataFrame, keys: Sequence[str], candidate_id: str, published_id: str) -> DataFrame:
    """A decision for each candidate: matched (one published row agrees, nulls alike), ambiguous, or novel.

    The published side is reduced to a row for each combination of keys before
    the join, so a common combination makes no pairs.
    """
    sums = published.groupBy(*keys).agg(F.count("*").alias("n_matches"), F.min(published_id).alias("match_id"))
    renamed = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_matches", "match_id")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = candidates.join(renamed, on, "left")
    n = F.coalesce("n_matches", F.lit(0))
    decision = F.when(n == 0, "novel").when(n == 1, "matched").otherwise("ambiguous")
    return joined.select(candidate_id, n.alias("n_matches"), F.when(n == 1, F.col("match_id")).alias("match_id"), decision.alias("decision"))


def overlay(official: DataFrame, curated: DataFrame, keys: Sequence[str], value: str, digest: str) -> DataFrame:
    """The curated value where its reviewed digest is still the official one; blocked where it has changed."""
    c = curated.select(*keys, F.col(value).alias("__curated"), F.col(digest).alias("__reviewed"))
    joined = official.join(c, list(keys), "left")
    fresh = F.col("__reviewed") == F.col(digest)
    return joined.withColumns({"applied": F.coalesce(fresh, F.lit(False)), "blocked": F.coalesce(~fresh, F.lit(False)), "effective": F.when(fresh, F.col("__curated")).otherwise(F.col(value))}).drop("__curated", "__reviewed")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the last row by order, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def as_of(events: DataFrame, facts: DataFrame, key: str, at: str, fact: Sequence[str], bucket: Column) -> DataFrame:
    """Each event with the latest of the facts of its key at or before it.

    Both sides go through one window by key and bucket (a coarser, monotonic
    function of `at`), with facts before events at the same time: no pairs are
    made, and a hot key is parted over its buckets.  What earlier buckets hold
    comes from a table of each bucket's last fact.
    """
    names = [c for c in events.columns if c not in (key, at)]
    kind = facts.select(F.struct(*fact).alias("f")).schema["f"].dataType
    left = events.select(key, at, bucket.alias("__b"), F.lit(1).alias("__kind"), F.struct(*names).alias("__event"), F.lit(None).cast(kind).alias("__fact"))
    right = facts.select(key, at, bucket.alias("__b"), F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), F.struct(*fact).alias("__fact"))
    w = W.partitionBy(key, "__b").orderBy(at, "__kind", "__fact").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionAll(right).withColumn("__last", F.last("__fact", ignorenulls=True).over(w)).where("__kind = 1")
    # Of each bucket that has events: the last fact of the buckets before it.
    ends = right.groupBy(key, "__b").agg(F.max_by("__fact", F.struct(at, "__fact")).alias("__end"))
    spans = ends.unionByName(both.select(key, "__b").distinct(), allowMissingColumns=True).groupBy(key, "__b").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    found = both.join(carried, [key, "__b"], "left").withColumn("__fact", F.coalesce("__last", "__carried"))
    return found.select(key, at, "__event.*", *[F.col("__fact").getField(f).alias(f"asof_{f}") for f in fact])
