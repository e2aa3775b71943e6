"""Queries of lookups in published revisions, reparsed evidence, layouts and censuses."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import games
from cartulary.catalogue.store import Catalogue
from cartulary.functions import canon
from cartulary.operators.lineage import checkpoint_dir, written
from cartulary.plans.registry import Tables, named
from cartulary.sources import adapters, census


def _catalogue(t: Tables) -> Catalogue:
    """Parts as cards of two games, orders as printings of the first."""
    spark = t.part.sparkSession
    catalogue = Catalogue(spark, f"{checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    k = F.col("p_partkey")
    cards = t.part.select(F.concat(F.lit("card_"), k).alias("id"), F.when(k % 2 == 1, "odd").otherwise("even").alias("game"), F.col("p_brand").alias("identity_value"), F.col("p_name").alias("name"))
    printings = t.orders.select(F.concat(F.lit("printing_"), "o_orderkey").alias("id"), F.concat(F.lit("card_"), F.col("o_custkey") % 700).alias("card_id"), F.col("o_orderstatus").alias("rarity"))
    first = catalogue.publish("odd", None, cards=cards.where("game = 'odd'"), printings=printings)
    catalogue.publish("even", first, cards=cards.where("game = 'even'"))
    return catalogue


@named("""
SELECT 'card_' || p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'odd' ELSE 'even' END AS game, p_name AS name FROM part WHERE p_partkey IN (SELECT c_custkey * 3 FROM customer WHERE c_acctbal > 5000)
""")
def q_id_lookup(t: Tables) -> DataFrame:
    """Many ids at once, over the batches of two games; some of them are nobody's."""
    catalogue = _catalogue(t)
    ids = t.customer.where("c_acctbal > 5000").select(F.concat(F.lit("card_"), F.col("c_custkey") * 3).alias("id"))
    found = written(catalogue.at().lookup("cards", ids).select("id", "game", "name"))
    catalogue.files.remove(catalogue.root)
    return found


@named("""
WITH v AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 40) AS value FROM supplier)
SELECT value, value IN (SELECT p_brand FROM part WHERE p_partkey % 2 = 1) AS known FROM v
""")
def q_known_values(t: Tables) -> DataFrame:
    """Which brands a filter on one game may ask for."""
    catalogue = _catalogue(t)
    values = t.supplier.select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40).alias("value"))
    found = written(catalogue.at().known_values("cards", "identity_value", values, "odd"))
    catalogue.files.remove(catalogue.root)
    return found


@named("""
SELECT 'printing_' || o_orderkey AS id, 'card_' || (o_custkey % 700) AS card_id FROM orders WHERE o_orderstatus = 'F' ORDER BY card_id, id LIMIT 100 OFFSET 100
""")
def q_printing_order(t: Tables) -> DataFrame:
    """The second page of printings, in the order of their cards and ids."""
    catalogue = _catalogue(t)
    query = catalogue.at().find("printings", rarity="F")
    _, cursor = query.page(limit=100)
    rows = query.page(limit=100, after=cursor)[0] if cursor else []
    catalogue.files.remove(catalogue.root)
    return t.part.sparkSession.createDataFrame([(r["id"], r["card_id"]) for r in rows], "id string, card_id string")


@named("""
WITH s AS (SELECT event_id, event_type AS lineage, props, CASE WHEN event_type = 'view' THEN 'v1' ELSE 'v2' END AS version FROM events WHERE event_type IN ('view', 'click')),
n AS (SELECT *, 'set_' || sha256(event_id || chr(31) || lineage || chr(31) || 'page' || chr(31) || version) AS set_id FROM s)
SELECT set_id, CAST(event_id AS VARCHAR) AS snapshot_id, version AS adapter, CASE WHEN version = 'v2' THEN '{"double":' || 2 * CAST(json_extract_string(props, '$.k') AS INTEGER) || '}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS record
FROM n WHERE version = 'v2' OR event_id % 3 <> 0
""")
def q_reparsed_sets(t: Tables) -> DataFrame:
    """Events parsed again: clicks under a new version, views only where they have no set yet."""
    registry = adapters.Registry()
    registry.register("view", "v1", "page")(lambda body: [json.loads(body)])
    registry.register("click", "v1", "page")(lambda body: [json.loads(body)])
    registry.register("click", "v2", "page")(lambda body: [{"double": 2 * json.loads(body)["k"]}])
    snapshots = t.events.select(F.col("event_id").cast("string").alias("snapshot_id"), F.col("event_type").alias("lineage"), F.lit("page").alias("surface"), F.col("props").alias("body"))
    none = t.part.sparkSession.createDataFrame([], "set_id string")
    # What an earlier run has left: all clicks by the first version, and a third of the views.
    before = snapshots.where("lineage = 'click' or snapshot_id % 3 = 0")
    sets = written(adapters.reparse(before, registry, none, {("click", "page"): "v1"}).select("set_id").distinct())
    return adapters.reparse(snapshots, registry, sets).select("set_id", "snapshot_id", "adapter", "record")


@named("""
WITH l AS (SELECT p_partkey, ['normal', 'split', 'transform', 'flip', 'token', 'reversible_card', 'no_such', 'adventure', 'saga'][p_partkey % 9 + 1] AS layout, p_size % 7 AS n FROM part)
SELECT p_partkey, layout, n, CASE WHEN layout IN ('transform', 'reversible_card') THEN CASE WHEN n = 2 THEN 'front,back' END WHEN layout = 'split' THEN CASE WHEN n BETWEEN 2 AND 5 THEN array_to_string(list_transform(range(n), lambda x: 'front'), ',') END
  WHEN layout IN ('flip', 'adventure') THEN CASE WHEN n = 2 THEN 'front,front' END WHEN layout <> 'no_such' THEN CASE WHEN n = 1 THEN 'front' END END AS roles FROM l
""")
def q_face_roles(t: Tables) -> DataFrame:
    """The roles of faces by layout; null where they don't fit."""
    names = F.array(*[F.lit(x) for x in ("normal", "split", "transform", "flip", "token", "reversible_card", "no_such", "adventure", "saga")])
    rows = t.part.select("p_partkey", F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("layout"), (F.col("p_size") % 7).alias("n"))
    return rows.withColumn("roles", F.array_join(games.roles_of(F.col("layout"), F.col("n")), ","))


@named("""
SELECT c_custkey, sha256('{"filters":{"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '},"limit":' || (c_custkey % 100) || ',"route":"cards"}') AS etag FROM customer
""")
def q_request_etags(t: Tables) -> DataFrame:
    """The tag of each customer's request, by its canonical form."""
    k = F.col("c_custkey")
    filters = F.struct(F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name"))
    return t.customer.select("c_custkey", canon.etags(F.struct(F.lit("cards").alias("route"), (k % 100).alias("limit"), filters.alias("filters"))).alias("etag"))


@named("""
WITH a AS (SELECT 's' || (c_custkey % 900) AS set_id, c_nationkey + 5 AS reported, c_custkey % 4 AS official FROM customer WHERE c_custkey % 900 < 800 OR c_custkey < 900),
b AS (SELECT 's' || (p_partkey % 1100) AS set_id, p_size % 25 + 5 AS reported, p_partkey % 4 AS official FROM part WHERE p_partkey % 1100 % 3 = 0 AND p_partkey < 1200),
x AS (SELECT set_id, min(reported) AS reported, min(official) AS official, count(*) AS n FROM a GROUP BY 1),
y AS (SELECT set_id, min(reported) AS r, min(official) AS o, count(*) AS m FROM b GROUP BY 1)
SELECT coalesce(x.set_id, y.set_id) AS set_id, reported, official, CASE WHEN n > 1 OR m > 1 THEN 'repeated' WHEN m IS NULL THEN 'candidate' WHEN n IS NOT NULL AND reported = r AND official = o THEN 'excluded' ELSE 'disagrees' END AS verdict
FROM x FULL JOIN y ON x.set_id = y.set_id
""")
def q_set_census(t: Tables) -> DataFrame:
    """Customers as an inventory of sets, parts as the digital ones: which are candidates."""
    c, k = F.col("c_custkey"), F.col("p_partkey")
    sets = t.customer.where((c % 900 < 800) | (c < 900)).select(F.concat(F.lit("s"), c % 900).alias("set_id"), (F.col("c_nationkey") + 5).alias("reported"), (c % 4).alias("official"))
    digital = t.part.where((k % 1100 % 3 == 0) & (k < 1200)).select(F.concat(F.lit("s"), k % 1100).alias("set_id"), (F.col("p_size") % 25 + 5).alias("reported"), (k % 4).alias("official"))
    return census.inventory(sets, digital)
