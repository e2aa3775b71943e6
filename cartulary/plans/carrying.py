"""Queries of what is carried from one revision to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import carry
from cartulary.plans.registry import Tables, named

# Lines tell of products (parts) by lineage (the return flag): before, what ships until 1998; now, what ships from then on.
_TOLD = """
told AS (SELECT p_brand AS game, l_partkey AS product_id, l_returnflag AS lineage, min(l_linestatus || l_shipdate::DATE) AS name, l_shipdate < TIMESTAMP '1998-01-01' AS before FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 5),
checked AS (SELECT DISTINCT p_brand AS game, f.x AS lineage FROM part, (VALUES ('A', 2), ('R', 3)) AS f(x, m) WHERE p_brand <> 'Brand#1' AND length(p_brand) % f.m = 0)
"""


def _told(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = t.lineitem.select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("lineage"), F.concat("l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("name"), (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("before"))
    parts = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("game"))
    told = lines.groupBy("product_id", "lineage", "before").agg(F.min("name").alias("name")).join(parts, "product_id")
    size = F.char_length("game")
    games = t.part.select(F.col("p_brand").alias("game")).distinct().where("game <> 'Brand#1'")
    checked = games.where(size % 2 == 0).select("game", F.lit("A").alias("lineage")).unionAll(games.where(size % 3 == 0).select("game", F.lit("R").alias("lineage")))
    return told.where("before").drop("before"), told.where("not before and product_id % 3 <> 0").drop("before"), checked


@named(f"""
WITH {_TOLD.strip()},
prior AS (SELECT * FROM told WHERE before), observed AS (SELECT * FROM told WHERE NOT before AND product_id % 3 <> 0),
state AS (SELECT game, product_id, 'published ' || min(name) AS name FROM prior GROUP BY 1, 2),
voices AS (
  SELECT game, product_id, lineage, name, false AS now FROM prior WHERE (game, lineage) NOT IN (SELECT game, lineage FROM checked)
  UNION ALL SELECT game, product_id, lineage, name, true FROM observed),
spoken AS (
  SELECT game, product_id, first(name ORDER BY CASE lineage WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 1073741824 END, lineage, NOT now, name) AS spoken, bool_or(now) AS observed, list_sort(list(DISTINCT lineage)) AS lineages FROM voices GROUP BY 1, 2),
gone AS (SELECT game, product_id, list_sort(list(DISTINCT lineage)) AS missed FROM prior WHERE (game, lineage) IN (SELECT game, lineage FROM checked) GROUP BY 1, 2),
every AS (SELECT game, product_id, s.name, p.spoken, p.observed, p.lineages FROM state s FULL JOIN spoken p USING (game, product_id))
SELECT e.game, e.product_id, coalesce(spoken, name) AS name, coalesce(observed, false) AS observed, coalesce(array_to_string(lineages, ','), '') AS lineages,
  CASE WHEN NOT coalesce(observed, false) AND name IS NOT NULL AND e.game IN (SELECT game FROM observed) THEN array_to_string(missed, ',') END AS missed
FROM every e LEFT JOIN gone g ON g.game = e.game AND g.product_id = e.product_id
""")
def q_carried_products(t: Tables) -> DataFrame:
    prior, observed, checked = _told(t)
    ranks = t.part.sparkSession.createDataFrame([("N", 1), ("R", 2)], "lineage string, rank int")
    state = prior.groupBy("game", "product_id").agg(F.concat(F.lit("published "), F.min("name")).alias("name"))
    found = carry.products(prior, observed, checked, ranks, state)
    return found.withColumns({"lineages": F.array_join("lineages", ","), "missed": F.array_join("missed", ",")})


@named(f"""
WITH {_TOLD.strip()},
prior AS (SELECT game, product_id AS context_id, bool_or(lineage <> 'N') AS observed, CASE WHEN product_id % 7 <> 0 THEN list_sort(list(DISTINCT lineage)) END AS lineages FROM told WHERE before GROUP BY game, product_id),
observed AS (SELECT game, product_id AS context_id, list_sort(list(DISTINCT lineage)) AS new FROM told WHERE NOT before AND product_id % 3 <> 0 GROUP BY 1, 2),
shown AS (SELECT game, list(lineage) AS gone FROM checked GROUP BY 1),
both_ AS (SELECT game, context_id, p.observed, p.lineages, o.new FROM prior p FULL JOIN observed o USING (game, context_id)),
left_ AS (SELECT b.*, s.gone, CASE WHEN s.gone IS NULL OR b.lineages IS NULL THEN b.lineages ELSE list_filter(b.lineages, lambda x: NOT list_contains(s.gone, x)) END AS rest FROM both_ b LEFT JOIN shown s ON s.game = b.game AND b.observed IS NOT NULL)
SELECT game, context_id, new IS NOT NULL OR CASE WHEN lineages IS NULL OR gone IS NULL THEN coalesce(observed, false) ELSE len(rest) > 0 END AS observed,
  CASE WHEN rest IS NULL AND new IS NULL THEN NULL ELSE array_to_string(list_sort(list_distinct(list_concat(coalesce(rest, []), coalesce(new, [])))), ',') END AS lineages
FROM left_
""")
def q_carried_contexts(t: Tables) -> DataFrame:
    prior, observed, checked = _told(t)
    name = F.col("product_id").alias("context_id")
    before = prior.groupBy("game", name).agg(F.max(F.col("lineage") != "N").alias("observed"), F.array_sort(F.collect_set("lineage")).alias("lineages"))
    before = before.withColumn("lineages", F.when(F.col("context_id") % 7 != 0, F.col("lineages")))
    found = carry.contexts(before, observed.select("game", name, "lineage"), checked)
    return found.withColumn("lineages", F.array_join("lineages", ","))


@named(f"""
WITH {_TOLD.strip()},
prior AS (SELECT game, product_id AS edge_id, max(lineage) AS lineage, max(name) AS label, count(*) % 2 = 1 AS observed, CASE WHEN product_id % 10 = 0 THEN 'curated' END AS category FROM told WHERE before GROUP BY 1, 2),
old AS (SELECT *, (game, lineage) IN (SELECT game, lineage FROM checked) AS told FROM prior WHERE category IS NULL),
fresh AS (SELECT game, product_id AS edge_id, first(lineage ORDER BY lineage, name) AS lineage, first(name ORDER BY lineage, name) AS label FROM told WHERE NOT before AND product_id % 3 <> 0 GROUP BY 1, 2)
SELECT game, edge_id, CASE WHEN takes THEN f.lineage ELSE o.lineage END AS lineage, CASE WHEN takes THEN f.label ELSE o.label END AS label, CASE WHEN takes THEN true WHEN told THEN false ELSE observed END AS observed
FROM (SELECT coalesce(o.game, f.game) AS game, coalesce(o.edge_id, f.edge_id) AS edge_id, o.edge_id IS NULL OR (o.told AND f.edge_id IS NOT NULL) AS takes, o, f, o.told AS told, o.observed AS observed FROM old o FULL JOIN fresh f ON f.game = o.game AND f.edge_id = o.edge_id)
""")
def q_carried_edges(t: Tables) -> DataFrame:
    prior, observed, checked = _told(t)
    name = F.col("product_id").alias("edge_id")
    before = prior.groupBy("game", name).agg(F.max("lineage").alias("lineage"), F.max("name").alias("label"), (F.count("*") % 2 == 1).alias("observed"))
    before = before.withColumn("category", F.when(F.col("edge_id") % 10 == 0, "curated"))
    return carry.edges(before, observed.select("game", name, "lineage", F.col("name").alias("label")), checked)


@named("""
WITH p AS (SELECT o_orderkey AS printing_id, 'g' || (o_custkey % 5) AS game, CASE WHEN o_custkey % 2 = 0 THEN 'number' ELSE 'code' END AS kind, CAST(o_custkey % 50 AS VARCHAR) AS value FROM orders),
s AS (SELECT DISTINCT 'g' || (c_custkey % 5) AS game, 'number' AS kind, CAST(c_custkey % 50 AS VARCHAR) AS value, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'R' END AS lineage FROM customer WHERE c_acctbal > 9000),
l AS (SELECT DISTINCT l_orderkey AS printing_id, l_returnflag AS lineage FROM lineitem)
SELECT p.printing_id, array_to_string(list_sort(list(DISTINCT s.lineage)), ',') AS lineages
FROM p JOIN s ON s.game = p.game AND s.kind = p.kind AND s.value = p.value JOIN l ON l.printing_id = p.printing_id AND l.lineage = s.lineage
WHERE p.printing_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1
""")
def q_scoped_disappearance(t: Tables) -> DataFrame:
    """Orders as printings that no large line shows now, by the lineages that were checked for their customer's identity."""
    c = F.col("o_custkey")
    published = t.orders.select(F.col("o_orderkey").alias("printing_id"), F.concat(F.lit("g"), c % 5).alias("game"), F.when(c % 2 == 0, "number").otherwise("code").alias("kind"), (c % 50).cast("string").alias("value"))
    k = F.col("c_custkey")
    scopes = t.customer.where("c_acctbal > 9000").select(F.concat(F.lit("g"), k % 5).alias("game"), F.lit("number").alias("kind"), (k % 50).cast("string").alias("value"), F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("R").alias("lineage"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("printing_id"), F.col("l_returnflag").alias("lineage"), "l_quantity")
    found = carry.scoped_disappearance(published, lines.where("l_quantity > 45"), lines, scopes)
    return found.withColumn("lineages", F.array_join("lineages", ","))
