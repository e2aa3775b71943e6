"""All named queries.

The catalogue's entities are stood for by the star schema: cards are parts
(game = brand), printings are order lines, products are orders, observations
are events, rules texts are documents.  Where a rule
compares two versions (a prior and a candidate, a plan and its observations),
both are derived from all rows of a table by a property of the row.  Limits
stand only where the rule is a page, a top list or a bounded summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def named(sql: str | None = None):
    """Register f(t: Tables) under its name, with the SQL that states the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from cartulary.plans import assembly, cards, carrying, control, curation, evidence, graphs, identities, ledgers, lookups, publish, reconcile, records, revisions, rules, selections  # noqa: E402, F401
