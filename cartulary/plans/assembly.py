"""Queries of a candidate's assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import assembly
from cartulary.plans.registry import Tables, named


@named("""
WITH o AS (SELECT o_custkey % 300 AS product_id, o_orderstatus AS lineage, o_orderpriority AS region, year(o_orderdate) AS event_key, strftime(o_orderdate, '%Y-%m') AS value, o_orderkey % 3 AS rank FROM orders),
v AS (SELECT product_id, lineage, region, event_key, value, min(rank) AS rank FROM o GROUP BY ALL),
b AS (SELECT product_id, lineage, region, event_key, count(*) AS n_values, min(rank) AS best FROM v GROUP BY ALL)
SELECT b.product_id, b.lineage, b.region, b.event_key, n_values, min(value) AS value, count(*) > 1 AS conflict, n_values - 1 AS disagreements,
  'release_' || sha256(b.product_id || chr(31) || b.lineage || chr(31) || b.region || chr(31) || b.event_key) AS release_id
FROM b JOIN v ON v.product_id = b.product_id AND v.lineage = b.lineage AND v.region = b.region AND v.event_key = b.event_key AND v.rank = b.best GROUP BY ALL
""")
def q_release_groups(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 300).alias("product_id"), F.col("o_orderstatus").alias("lineage"), F.col("o_orderpriority").alias("region"), F.year("o_orderdate").alias("event_key"), F.date_format("o_orderdate", "yyyy-MM").alias("value"), (F.col("o_orderkey") % 3).alias("rank"))
    return assembly.group_releases(rows, "value", "rank")


@named("""
WITH m AS (SELECT CAST(l_partkey AS VARCHAR) AS printing_id, l_returnflag AS lineage, CASE WHEN l_linenumber % 2 = 0 THEN 'product' ELSE 'context' END AS kind, 'S' || l_suppkey % 40 AS label FROM lineitem),
k AS (SELECT 'S' || s_suppkey AS label, 'P' || s_suppkey AS known FROM supplier WHERE s_suppkey % 2 = 0),
d AS (SELECT kind, printing_id AS from_id, CASE WHEN kind = 'product' THEN coalesce(known, 'product_' || sha256(m.label)) ELSE 'context_' || sha256(lineage || chr(31) || m.label) END AS to_id, lineage FROM m LEFT JOIN k ON k.label = m.label)
SELECT DISTINCT kind, from_id, to_id, lineage, CASE WHEN kind = 'product' AND to_id LIKE 'P%' AND lineage = 'A' THEN 'declared' ELSE 'derived' END AS origin FROM d
""")
def q_membership_edges(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").cast("string").alias("printing_id"), F.col("l_returnflag").alias("lineage"), F.when(F.col("l_linenumber") % 2 == 0, "product").otherwise("context").alias("kind"), F.concat(F.lit("S"), F.col("l_suppkey") % 40).alias("label"))
    products = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.concat(F.lit("P"), "s_suppkey").alias("product_id"))
    known = rows.where("kind = 'product' and lineage = 'A'").join(products.withColumnRenamed("code", "label"), "label")
    declared = known.select("kind", F.col("printing_id").alias("from_id"), F.col("product_id").alias("to_id"), "lineage").distinct()
    return assembly.membership_edges(rows, products, declared)


@named("""
WITH c AS (SELECT p_partkey AS card_id, p_brand AS game, CASE WHEN p_partkey % 9 = 0 THEN 'art' ELSE 'gameplay' END AS category, p_size % 40 AS artwork FROM part)
SELECT a.card_id, CASE WHEN count(b.card_id) = 1 THEN min(b.card_id) END AS related_id, CASE count(b.card_id) WHEN 0 THEN 'unrelated' WHEN 1 THEN 'related' ELSE 'ambiguous' END AS outcome
FROM c a LEFT JOIN c b ON b.category <> 'art' AND b.game = a.game AND b.artwork = a.artwork WHERE a.category = 'art' GROUP BY 1
""")
def q_shared_artwork(t: Tables) -> DataFrame:
    cards = t.part.select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("game"), F.when(F.col("p_partkey") % 9 == 0, "art").otherwise("gameplay").alias("category"), (F.col("p_size") % 40).alias("artwork"))
    return assembly.shared_artwork(cards)


@named("""
WITH p AS (SELECT DISTINCT o_custkey AS c FROM orders), s AS (SELECT s_suppkey, s_nationkey FROM supplier)
SELECT 'product' AS kind, 'P' || c AS id, NULL AS parent_id, NULL AS detail FROM p
UNION ALL SELECT DISTINCT 'release', 'R' || o_custkey || '-' || year(o_orderdate), 'P' || o_custkey, CAST(year(o_orderdate) AS VARCHAR) FROM orders
UNION ALL SELECT 'erratum', 'E' || s_suppkey, 'C' || s_nationkey, NULL FROM s
UNION ALL SELECT 'erratum-target', 'E' || s_suppkey, 'C' || s_nationkey, l FROM s, (VALUES ('a'), ('b')) AS x(l)
""")
def q_record_derivation(t: Tables) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    release = F.struct(F.concat(F.lit("R"), "o_custkey", F.lit("-"), year).alias("id"), year.alias("detail"))
    products = t.orders.groupBy(F.concat(F.lit("P"), "o_custkey").alias("id")).agg(F.collect_set(release).alias("releases"))
    errata = t.supplier.select(F.concat(F.lit("E"), "s_suppkey").alias("id"), F.concat(F.lit("C"), "s_nationkey").alias("target_id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("lineages"))
    return assembly.derived_records(products, errata)


@named("""
WITH e AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE NOT (l_suppkey % 5 = 0 AND l_partkey % 2 = 0))
SELECT l_partkey AS printing_id, count(*) AS n_members, string_agg(l_suppkey || ':' || l_returnflag, ',' ORDER BY l_suppkey, l_returnflag) AS members FROM e GROUP BY 1
""")
def q_printing_projection(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_returnflag").alias("lineage"))
    absent = edges.where("to_id % 5 = 0 and from_id % 2 = 0").select("from_id", "to_id")
    rows = assembly.printing_projection(edges, absent)
    text = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["to_id"].cast("string"), m["lineage"])), ",")
    return rows.select("printing_id", F.size("members").alias("n_members"), text.alias("members"))


@named("""
WITH d AS (SELECT c_nationkey AS source, c_custkey % 6 + 1 AS generation, min(c_mktsegment) AS seg FROM customer GROUP BY 1, 2),
s AS (SELECT source, generation, CASE WHEN seg < 'B' THEN 'retired' ELSE 'active' END AS state FROM d WHERE NOT (source % 7 = 0 AND generation = 2))
SELECT source, max_by(state, generation) AS state, max(generation) AS generation, count(*) <> max(generation) OR (source % 3 = 0 AND max_by(state, generation) = 'retired') AS illegal FROM s GROUP BY 1
""")
def q_source_lifecycle(t: Tables) -> DataFrame:
    d = t.customer.groupBy(F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 6 + 1).alias("generation")).agg(F.min("c_mktsegment").alias("seg"))
    rows = d.where("not (source % 7 = 0 and generation = 2)").select("source", "generation", F.when(F.col("seg") < "B", "retired").otherwise("active").alias("state"))
    return assembly.source_states(rows, rows.where("source % 3 = 0"), "source")


@named("""
WITH o AS (SELECT user_id AS printing_id, max_by(CASE WHEN value > 30 THEN 'http://x/' || event_id ELSE '' END, (ts, event_id)) AS link FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT printing_id, link FROM o WHERE link <> '' AND printing_id % 4 <> 0
""")
def q_image_links(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("printing_id"), F.col("ts").alias("captured_at"), F.col("event_id").alias("observation_id"), (F.col("event_type") != "view").alias("opted_in"), F.when(F.col("value") > 30, F.concat(F.lit("http://x/"), "event_id")).alias("link"))
    return assembly.image_links(rows, rows.where("printing_id % 4 = 0"))


@named("""
WITH n AS (SELECT s_nationkey AS lineage, s_suppkey AS key, CASE WHEN s_suppkey % 37 = 0 THEN sha256('changed') ELSE sha256(s_name) END AS digest FROM supplier WHERE s_suppkey % 41 <> 0)
SELECT s_nationkey AS lineage, count(*) AS n_accepted, bool_and(coalesce(n.digest = sha256(s_name), false)) AS unchanged FROM supplier LEFT JOIN n ON n.key = s_suppkey GROUP BY 1
""")
def q_accepted_unchanged(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_nationkey").alias("lineage"), F.col("s_suppkey").alias("key"), F.sha2("s_name", 256).alias("digest"))
    now = rows.where("key % 41 <> 0").withColumn("digest", F.when(F.col("key") % 37 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("digest")))
    return assembly.accepted_unchanged(rows, now, "lineage", "key", "digest")


@named("""
SELECT page_id, md5(substring(html, 101, 100)) AS part_md5, CASE WHEN strlen(html) > 100 THEN true ELSE false END AS satisfiable FROM (SELECT page_id, regexp_replace(html, '[^ -~]', '?', 'g') AS html FROM pages)
""")
def q_byte_range(t: Tables) -> DataFrame:
    ascii_only = F.regexp_replace("html", r"[^ -~]", "?").cast("binary")
    part = assembly.byte_range(ascii_only, F.lit(100), F.lit(199))
    return t.pages.select("page_id", F.md5(F.coalesce(part, F.lit(b""))).alias("part_md5"), part.isNotNull().alias("satisfiable"))
