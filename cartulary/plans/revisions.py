"""Reads of published revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue.indexes import gram_text, grams
from cartulary.catalogue.store import Catalogue
from cartulary.operators.lineage import checkpoint_dir, small_batches, written
from cartulary.plans.registry import Tables, named


def _catalogue(t: Tables) -> tuple[Catalogue, list[str]]:
    """A catalogue in the shared folder, and its revisions: odd cards, then even ones too, then fewer odd ones."""
    spark = t.part.sparkSession
    cards = t.part.select(
        F.concat(F.lit("card_"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 1, "odd").otherwise("even").alias("game"), F.lit("brand").alias("identity_kind"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("identity_value"), F.col("p_name").alias("name"), "p_size",
    )
    catalogue = Catalogue(spark, f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    made: list[str] = []
    for game, rows in (("odd", cards), ("even", cards), ("odd", cards.where("p_size > 10"))):
        made.append(catalogue.publish(game, made[-1] if made else None, cards=rows.where(F.col("game") == game).drop("p_size")))
    return catalogue, made


@named("""
WITH c AS (SELECT 'card_' || p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'odd' ELSE 'even' END AS game, p_name AS name, p_size FROM part)
SELECT 'first' AS revision, id, game, name FROM c WHERE game = 'odd'
UNION ALL SELECT 'second', id, game, name FROM c
UNION ALL SELECT 'current', id, game, name FROM c WHERE game = 'even' OR p_size > 10
""")
def q_pinned_reads(t: Tables) -> DataFrame:
    """Three revisions read side by side: a pinned one stays as it was published."""
    catalogue, (first, second, _) = _catalogue(t)
    read = lambda name, revision: catalogue.at(revision).entities("cards").select(F.lit(name).alias("revision"), "id", "game", "name")
    found = written(read("first", first).unionAll(read("second", second)).unionAll(read("current", None)))
    catalogue.files.remove(catalogue.root)
    return found


@named("""
SELECT id, identity_value, name FROM (
  SELECT 'card_' || p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS identity_value, p_name AS name FROM part WHERE p_partkey % 2 = 1)
WHERE contains(lower(name), 'e') OR contains(lower(identity_value), 'e') ORDER BY identity_value NULLS LAST, id LIMIT 30 OFFSET 30
""")
def q_cursor_page(t: Tables) -> DataFrame:
    """The second page of a search in one game, by the first one's cursor."""
    catalogue, (first, *_) = _catalogue(t)
    query = catalogue.at(first).find("cards", game="odd", q=" E ")
    _, cursor = query.page(limit=30)
    rows = query.page(limit=30, after=cursor)[0] if cursor else []
    catalogue.files.remove(catalogue.root)
    return t.part.sparkSession.createDataFrame([(r["id"], r["identity_value"], r["name"]) for r in rows], "id string, identity_value string, name string")


@named("""
SELECT game, attribute, value, count(*) AS n_cards FROM (
  SELECT p_brand AS game, 'type' AS attribute, '"' || p_type || '"' AS value FROM part UNION ALL SELECT p_brand, 'size', CAST(p_size AS VARCHAR) FROM part)
WHERE game IN ('Brand#1', 'Brand#2') GROUP BY 1, 2, 3
""")
def q_attribute_values(t: Tables) -> DataFrame:
    """What attribute filters of two published games may ask for."""
    spark = t.part.sparkSession
    catalogue = Catalogue(spark, f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    attributes = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size")))
    cards = t.part.select(F.concat(F.lit("card_"), "p_partkey").alias("id"), F.col("p_brand").alias("game"), F.col("p_name").alias("name"), attributes.alias("attributes"))
    revision = None
    for game in ("Brand#1", "Brand#2"):
        revision = catalogue.publish(game, revision, cards=cards.where(F.col("game") == game))
    values = [catalogue.at().attribute_values(g).select(F.lit(g).alias("game"), "attribute", "value", "n_cards") for g in ("Brand#1", "Brand#2")]
    found = written(values[0].unionAll(values[1]))
    catalogue.files.remove(catalogue.root)
    return found


def _published(t: Tables, *names: Column) -> Catalogue:
    """The documents as one game's cards (with these columns besides), in a catalogue in the shared folder."""
    spark = t.documents.sparkSession
    catalogue = Catalogue(spark, f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    cards = t.documents.select(F.concat(F.lit("card_"), "doc_id").alias("id"), F.lit("prose").alias("game"), F.col("text").alias("rules_text"), *names)
    catalogue.publish("prose", None, cards=cards)
    return catalogue


@named("""
SELECT 'en de' AS q, 'card_' || doc_id AS id FROM documents WHERE contains(lower(text), 'en de') OR contains(lower(source), 'en de')
UNION ALL SELECT 'tion of th', 'card_' || doc_id FROM documents WHERE contains(lower(text), 'tion of th')
UNION ALL SELECT 'zu', 'card_' || doc_id FROM documents WHERE contains(lower(text), 'zu')
UNION ALL SELECT 'zzqzz', 'card_' || doc_id FROM documents WHERE contains(lower(text), 'zzqzz')
""")
def q_indexed_search(t: Tables) -> DataFrame:
    """Searches over the postings of a published batch; one of two code points scans."""
    catalogue = _published(t, F.col("source").alias("name"))
    found = None
    for q in ("en de", "Tion of th", "zu", "zzqzz"):
        one = catalogue.at().search("cards", q).select(F.lit(q.lower()).alias("q"), "id")
        found = one if found is None else found.unionAll(one)
    found = written(found)
    catalogue.files.remove(catalogue.root)
    return found


@named(r"""
WITH c AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents WHERE length(text) >= 3),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c)
SELECT gram, count(DISTINCT doc_id) AS n_cards FROM g GROUP BY 1
""")
def q_repaired_postings(t: Tables) -> DataFrame:
    """The postings after one bucket has been lost and another one emptied, and both were made again."""
    catalogue = _published(t)
    spark = t.documents.sparkSession
    index = catalogue.index("cards", catalogue.at().batches["prose"])
    buckets = [r["bucket"] for r in index.stored("grams").select("bucket").distinct().orderBy("bucket").limit(2).collect()]
    catalogue.files.remove(f"{index.folder}/grams/bucket={buckets[0]}")
    spark.createDataFrame([], "key bigint, ids array<string>").write.mode("overwrite").parquet(f"{index.folder}/grams/bucket={buckets[1]}")
    while index.repair(most=1):
        pass
    n = index.stored("grams").groupBy("key").agg(F.sum(F.size("ids")).alias("n"))
    # Postings are of compatibility forms; what only such a form has is no part of the text.
    forms = catalogue.at().entities("cards").where("id is not null").select(F.lower("rules_text").alias("body"), F.col("search_text")[0].alias("form")).where("form <> body")
    foreign = forms.select("body", F.explode(grams(F.array("form"))).alias("key")).where(~F.contains("body", gram_text(F.col("key")))).groupBy("key").agg(F.count("*").alias("foreign"))
    rows = n.join(foreign, "key", "left").select(gram_text(F.col("key")).alias("gram"), (F.col("n") - F.coalesce("foreign", F.lit(0))).alias("n_cards"))
    with small_batches(spark):
        found = written(rows.where("n_cards > 0"))
    catalogue.files.remove(catalogue.root)
    return found
