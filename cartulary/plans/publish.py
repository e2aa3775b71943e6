"""Diffs, digests, composition, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import identity, publish
from cartulary.plans.registry import Tables, named


@named("""
(SELECT c_custkey AS key, 'left' AS side FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey, 'left' FROM orders WHERE o_orderstatus = 'P')
UNION ALL (SELECT o_custkey, 'right' FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 5000)
""")
def q_symmetric_diff(t: Tables) -> DataFrame:
    return publish.symmetric_difference(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("key")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


@named("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@named("""
WITH b AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS e FROM orders WHERE o_orderkey % 10 < 8),
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'seen again' ELSE o_orderpriority END AS e FROM orders WHERE o_orderkey % 10 > 1)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed'
  WHEN b.s = a.s AND b.e = a.e THEN 'carry_forward' WHEN b.s = a.s THEN 'evidence_only' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey
""")
def q_candidate_diff(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("e"))
    after = rows.where(k % 10 > 1).withColumns({"s": F.when(k % 5 == 0, "X").otherwise(F.col("s")), "e": F.when(k % 3 == 0, "seen again").otherwise(F.col("e"))})
    return publish.diff(rows.where(k % 10 < 8), after, ["o_orderkey"], ["s"], ["e"])


_CHANGES = """
WITH b AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 8), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 > 1)
SELECT CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN b.s = a.s THEN 'carry_forward' ELSE 'changed' END AS change, count(*) AS n
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey GROUP BY 1
"""


@named(_CHANGES)
def q_change_counts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s"))
    after = rows.where(k % 10 > 1).withColumn("s", F.when(k % 5 == 0, "X").otherwise(F.col("s")))
    return publish.diff(rows.where(k % 10 < 8), after, ["o_orderkey"], ["s"]).groupBy("change").agg(F.count("*").alias("n"))


@named("""
WITH blocks AS (SELECT p_brand, p_partkey // 1000 AS b, count(*) AS n, sha256(string_agg(p_partkey || '|' || p_name || '|' || p_type, chr(10) ORDER BY p_partkey)) AS d FROM part GROUP BY 1, 2)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM blocks GROUP BY 1
""")
def q_semantic_digest(t: Tables) -> DataFrame:
    line = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_type")
    return publish.set_digest(t.part, ["p_brand"], "p_partkey", line, 1000)


@named("""
WITH RECURSIVE p AS (SELECT o_orderkey AS c, o_orderkey // 2 AS p FROM orders WHERE o_orderkey > 0),
f AS (SELECT c, p AS ancestor, 1 AS distance FROM p UNION ALL SELECT f.c, p.p, f.distance + 1 FROM f JOIN p ON p.c = f.ancestor WHERE f.distance < 4)
SELECT c AS revision, ancestor, distance FROM f
""")
def q_revision_ancestry(t: Tables) -> DataFrame:
    parents = t.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("revision"), F.expr("o_orderkey div 2").alias("parent"))
    return identity.ancestors(parents, "revision", "parent", 4)


@named("""
SELECT p_brand, p_partkey, 'rev1' AS revision FROM part WHERE p_brand <> (SELECT max(p_brand) FROM part)
UNION ALL SELECT p_brand, p_partkey + 1000000, 'rev2' FROM part WHERE p_brand = (SELECT max(p_brand) FROM part) AND p_size > 10
""")
def q_composition_replace(t: Tables) -> DataFrame:
    last = F.broadcast(t.part.agg(F.max("p_brand").alias("p_brand")))
    fresh = t.part.where("p_size > 10").join(last, "p_brand", "left_semi").select("p_brand", (F.col("p_partkey") + 1_000_000).alias("p_partkey"), F.lit("rev2").alias("revision"))
    return publish.replace_group(t.part.select("p_brand", "p_partkey", F.lit("rev1").alias("revision")), fresh, "p_brand")


@named("""
WITH l AS (SELECT s_nationkey, s_suppkey, '{"id":' || s_suppkey || ',"name":"' || s_name || '"}' AS line FROM supplier)
SELECT s_nationkey, count(*) AS n_records, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, max(strlen(line)) <= 524288 AS within_limit FROM l GROUP BY 1
""")
def q_export_component(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    rows = t.supplier.select("s_nationkey", F.octet_length(line).cast("bigint").alias("bytes"))
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("n_records"), F.sum(F.col("bytes") + 1).alias("n_bytes"), (F.max("bytes") <= 512 * 1024).alias("within_limit"))


@named("""
SELECT coalesce(p.k, s.k) AS k, CASE WHEN p.k IS NULL THEN 'r2' ELSE 'r1' END AS first, CASE WHEN s.k IS NULL THEN 'r1' ELSE 'r2' END AS last, s.k IS NULL AS withdrawn
FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0) p FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON s.k = p.k
""")
def q_lifecycle_carry(t: Tables) -> DataFrame:
    prior = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"), F.lit("r1").alias("first"), F.lit("r1").alias("last")).distinct()
    return publish.carry_lifecycle(prior, t.supplier.select(F.col("s_nationkey").alias("k")), "k", "r2")
