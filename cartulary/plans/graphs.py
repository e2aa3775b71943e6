"""Queries over graphs: what is retained, whether a run's requests are closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import closure, reconcile
from cartulary.plans.registry import Tables, named


@named("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS child, (l_orderkey * 31 + l_partkey * 7) % (SELECT max(o_orderkey) + 1 FROM orders) AS parent FROM lineitem WHERE l_returnflag <> 'N'),
r(node) AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 495000 UNION SELECT parent FROM r JOIN e ON e.child = r.node)
SELECT o_orderkey, node IS NOT NULL AS retained FROM orders LEFT JOIN r ON node = o_orderkey
""")
def q_retained_closure(t: Tables) -> DataFrame:
    """Dear orders and all that they derive from, over many parents and cycles, are kept."""
    most = t.orders.agg((F.max("o_orderkey") + 1).alias("n"))
    context = t.lineitem.where("l_returnflag <> 'N'").crossJoin(F.broadcast(most)).select(F.col("l_orderkey").alias("child"), ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 7) % F.col("n")).alias("parent"))
    return reconcile.retained(t.orders.select("o_orderkey"), "o_orderkey", context, "child", "parent", t.orders.where("o_totalprice > 495000").select("o_orderkey"))


_ROLE = "CASE k % 10 WHEN 0 THEN 'surface' WHEN 1 THEN 'image' WHEN 2 THEN 'detail' WHEN 3 THEN 'detail' ELSE 'listing' END"


@named(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS lineage, o_orderstatus AS st FROM orders),
r AS (
  SELECT k AS request_id, lineage, {_ROLE} AS role, CASE WHEN k % 10 = 0 THEN st || (k % 3) END AS surface,
    CASE WHEN k % 10 = 0 THEN CASE WHEN k % 700 = 0 THEN k + 1 END WHEN k % 113 <> 5 THEN (k // 10) * 10 + CASE WHEN k % 97 = 3 THEN 1000000 ELSE 0 END END AS parent_id,
    'p' || (c % 7) AS partition, k // 40 AS first, k // 40 + CASE WHEN k % 211 = 4 THEN 2 ELSE 0 END AS last, CASE WHEN k % 10 IN (2, 3) THEN 'd' || (k // 20) END AS locator,
    k % 50 AS declared, CASE WHEN k % 331 <> 7 THEN k % 50 END AS parsed, CASE WHEN k % 10 = 1 THEN CASE WHEN k % 41 = 1 THEN 1 ELSE 0 END ELSE k % 17 END AS records FROM o),
l AS (SELECT l_orderkey AS request_id, o.lineage, 'd' || (l_orderkey // 20 + CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS locator, l_returnflag AS meaning FROM lineitem JOIN o ON o.k = l_orderkey WHERE l_orderkey % 10 > 3),
q AS (SELECT DISTINCT lineage, s.st || n.n AS surface FROM o, (VALUES ('F'), ('O'), ('X')) AS s(st), (VALUES (0), (1)) AS n(n)),
g AS (SELECT DISTINCT lineage, partition, first AS lo, last AS hi FROM r WHERE role = 'listing'),
f AS (SELECT *, max(hi) OVER (PARTITION BY lineage, partition ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g),
e AS (SELECT lineage, locator, min(request_id) AS a, max(request_id) AS b, min(meaning) AS x, max(meaning) AS y FROM l GROUP BY 1, 2),
d AS (SELECT DISTINCT lineage, locator FROM r WHERE role = 'detail'),
s AS (SELECT DISTINCT lineage, surface FROM r WHERE role = 'surface')
SELECT 'count_open' AS kind, lineage, CAST(request_id AS VARCHAR) AS subject FROM r WHERE declared IS DISTINCT FROM parsed
UNION ALL SELECT 'root_with_parent', lineage, CAST(request_id AS VARCHAR) FROM r WHERE role = 'surface' AND parent_id IS NOT NULL
UNION ALL SELECT 'parent_unnamed', lineage, CAST(request_id AS VARCHAR) FROM r WHERE role <> 'surface' AND parent_id IS NULL
UNION ALL SELECT 'parent_missing', lineage, CAST(request_id AS VARCHAR) FROM r WHERE role <> 'surface' AND parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r p WHERE p.request_id = r.parent_id)
UNION ALL SELECT 'image_with_records', lineage, CAST(request_id AS VARCHAR) FROM r WHERE role = 'image' AND records > 0
UNION ALL SELECT 'detail_without_records', lineage, CAST(request_id AS VARCHAR) FROM r WHERE role = 'detail' AND records = 0
UNION ALL SELECT CASE WHEN lo > b + 1 THEN 'page_gap' ELSE 'page_overlap' END, lineage, partition || '#' || CASE WHEN lo > b + 1 THEN b + 1 ELSE lo END FROM f WHERE lo <> b + 1
UNION ALL SELECT 'locator_overlap', lineage, locator FROM e WHERE a <> b AND x <> y
UNION ALL SELECT 'detail_missing', lineage, locator FROM e WHERE (lineage, locator) NOT IN (SELECT lineage, locator FROM d)
UNION ALL SELECT 'detail_unlisted', lineage, locator FROM d WHERE (lineage, locator) NOT IN (SELECT lineage, locator FROM e)
UNION ALL SELECT 'surface_missing', lineage, surface FROM q WHERE (lineage, surface) NOT IN (SELECT lineage, surface FROM s)
UNION ALL SELECT 'surface_unexpected', lineage, surface FROM s WHERE (lineage, surface) NOT IN (SELECT lineage, surface FROM q)
""")
def q_request_graph(t: Tables) -> DataFrame:
    """Every violation of a request graph laid over orders (requests) and their lines (entries of listings)."""
    k = F.col("o_orderkey")
    role = F.when(k % 10 == 0, "surface").when(k % 10 == 1, "image").when((k % 10).isin(2, 3), "detail").otherwise("listing")
    above = F.expr("o_orderkey div 10") * 10 + F.when(k % 97 == 3, 1_000_000).otherwise(0)
    page = F.expr("o_orderkey div 40")
    requests = t.orders.select(
        k.alias("request_id"), F.col("o_orderpriority").alias("lineage"), role.alias("role"), F.when(k % 10 == 0, F.concat("o_orderstatus", k % 3)).alias("surface"),
        F.when(k % 10 == 0, F.when(k % 700 == 0, k + 1)).when(k % 113 != 5, above).alias("parent_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("partition"), page.alias("first"), (page + F.when(k % 211 == 4, 2).otherwise(0)).alias("last"),
        F.when((k % 10).isin(2, 3), F.concat(F.lit("d"), F.expr("o_orderkey div 20"))).alias("locator"), (k % 50).alias("declared"), F.when(k % 331 != 7, k % 50).alias("parsed"),
        F.when(k % 10 == 1, F.when(k % 41 == 1, 1).otherwise(0)).otherwise(k % 17).alias("records"),
    )
    entry = F.expr("l_orderkey div 20") + F.when(F.col("l_quantity") > 49, 1).otherwise(0)
    lines = t.lineitem.where("l_orderkey % 10 > 3").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("d"), entry).alias("locator"), F.col("l_returnflag").alias("meaning"))
    listed = lines.join(requests.select("request_id", "lineage"), "request_id")
    surfaces = F.explode(F.array(*[F.lit(s + n) for s in "FOX" for n in "01"])).alias("surface")
    return closure.violations(requests, listed, t.orders.select(F.col("o_orderpriority").alias("lineage")).distinct().select("lineage", surfaces), block=50)
