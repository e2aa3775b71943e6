"""Resolution of conflicting observations, matching, curation, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import identity, resolve
from cartulary.plans.registry import Tables, named


@named("""
WITH v AS (SELECT l_orderkey, nullif(l_returnflag, 'N') AS value, min(CAST(l_linenumber AS BIGINT) // 3) AS rank FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey, count(value) AS n_values, min(rank) FILTER (WHERE value IS NOT NULL) AS best FROM v GROUP BY 1)
SELECT b.l_orderkey, n_values, min(value) AS value, count(value) > 1 AS conflict, greatest(n_values - 1, 0) AS disagreements
FROM b LEFT JOIN v ON v.l_orderkey = b.l_orderkey AND v.rank = b.best AND v.value IS NOT NULL GROUP BY 1, 2
""")
def q_fact_resolution(t: Tables) -> DataFrame:
    facts = t.lineitem.select("l_orderkey", F.expr("nullif(l_returnflag, 'N')").alias("value"), F.expr("l_linenumber div 3").alias("rank"))
    return resolve.resolve_facts(facts, ["l_orderkey"], "value", "rank")


@named("""
SELECT l_partkey, count(*) AS n_facts, min(l_returnflag || '/' || l_linestatus) AS first_fact FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1 HAVING count(*) > 1
""")
def q_context_conflict(t: Tables) -> DataFrame:
    rows = resolve.disagreeing(t.lineitem, ["l_partkey"], ["l_returnflag", "l_linestatus"])
    return rows.select("l_partkey", "n_facts", F.concat_ws("/", "first_fact.l_returnflag", "first_fact.l_linestatus").alias("first_fact"))


@named("""
SELECT user_id, count(DISTINCT event_type) AS n_meanings, min(event_id) AS first_assertion, count(DISTINCT event_type) > 1 AS conflict FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1
""")
def q_withdrawal_conflict(t: Tables) -> DataFrame:
    each = t.events.where("event_type in ('signup', 'error')").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return each.groupBy("user_id").agg(F.count("*").alias("n_meanings"), F.min("first").alias("first_assertion"), (F.count("*") > 1).alias("conflict"))


@named("""
SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, superseded_others FROM (
  SELECT *, count(*) OVER (PARTITION BY l_partkey) > 1 AS superseded_others,
    row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linestatus, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1
""")
def q_authority_pick(t: Tables) -> DataFrame:
    authority = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    best = resolve.pick(rows, ["l_partkey"], [authority, F.col("l_linestatus"), F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "superseded_others")


_KEYS = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]


@named("""
WITH p AS (SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, count(*) AS n, min(l_orderkey) AS m FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 3, 4, 5)
SELECT c.l_orderkey * 10 + c.l_linenumber AS observation, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN m END AS match_id,
  CASE WHEN n IS NULL THEN 'novel' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS decision
FROM lineitem c LEFT JOIN p ON p.l_partkey = c.l_partkey AND p.l_suppkey = c.l_suppkey AND p.l_returnflag = c.l_returnflag AND p.l_linestatus = c.l_linestatus AND p.l_quantity IS NOT DISTINCT FROM c.l_quantity
WHERE c.l_orderkey % 2 = 1
""")
def q_compatibility_match(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", *_KEYS)
    candidates = lines.where("l_orderkey % 2 = 1").withColumn("observation", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return resolve.compatible(candidates, lines.where("l_orderkey % 2 = 0"), _KEYS, "observation", "l_orderkey")


@named("""
WITH p AS (SELECT l_partkey, l_suppkey, l_linenumber, count(*) AS n, min(l_orderkey) AS m FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 3)
SELECT c.l_orderkey * 10 + c.l_linenumber AS observation, n AS n_matches, CASE WHEN n = 1 THEN m END AS match_id, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS decision
FROM lineitem c JOIN p ON p.l_partkey = c.l_partkey AND p.l_suppkey = c.l_suppkey AND p.l_linenumber = c.l_linenumber WHERE c.l_orderkey % 2 = 1
""")
def q_locator_match(t: Tables) -> DataFrame:
    keys = ["l_partkey", "l_suppkey", "l_linenumber"]
    lines = t.lineitem.select("l_orderkey", *keys)
    candidates = lines.where("l_orderkey % 2 = 1").withColumn("observation", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return resolve.compatible(candidates, lines.where("l_orderkey % 2 = 0"), keys, "observation", "l_orderkey").where("n_matches > 0")


@named("""
WITH RECURSIVE r AS (SELECT p_partkey AS s, p_partkey // 3 AS t FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0),
f AS (SELECT s, t, 1 AS n FROM r UNION ALL SELECT f.s, r.t, f.n + 1 FROM f JOIN r ON r.s = f.t)
SELECT s AS retired, max_by(t, n) AS final, max(n) AS steps FROM f GROUP BY 1
""")
def q_identity_redirect(t: Tables) -> DataFrame:
    merges = t.part.where("p_partkey % 3 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("retired"), F.expr("p_partkey div 3").alias("target"))
    return identity.follow(merges, "retired", "target")


@named("""
SELECT p_partkey, coalesce(reviewed = digest, false) AS applied, coalesce(reviewed <> digest, false) AS blocked, CASE WHEN reviewed = digest THEN 'curated ' || p_name ELSE p_name END AS effective FROM (
  SELECT p_partkey, p_name, sha256(p_name) AS digest, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN sha256(p_name) ELSE sha256('') END END AS reviewed FROM part)
""")
def q_curated_overlay(t: Tables) -> DataFrame:
    official = t.part.select("p_partkey", F.col("p_name").alias("name"), F.sha2("p_name", 256).alias("digest"))
    reviewed = F.when(F.col("p_partkey") % 2 == 0, F.col("digest")).otherwise(F.sha2(F.lit(""), 256))
    curated = official.where("p_partkey % 7 = 0").select("p_partkey", F.concat(F.lit("curated "), "name").alias("name"), reviewed.alias("digest"))
    return resolve.overlay(official, curated, ["p_partkey"], "name", "digest").select("p_partkey", "applied", "blocked", "effective")


@named("""
WITH h AS (SELECT l_partkey, l_returnflag, min(year(l_shipdate)) AS first_revision, max(year(l_shipdate)) AS last_revision FROM lineitem GROUP BY 1, 2)
SELECT *, last_revision = (SELECT max(year(l_shipdate)) FROM lineitem) AS current FROM h
""")
def q_history_scd(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_returnflag", F.year("l_shipdate").cast("bigint").alias("revision"))
    history = rows.groupBy("l_partkey", "l_returnflag").agg(F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"))
    newest = rows.agg(F.max("revision").alias("newest"))
    return history.crossJoin(F.broadcast(newest)).select("l_partkey", "l_returnflag", "first_revision", "last_revision", (F.col("last_revision") == F.col("newest")).alias("current"))


@named("""
WITH prior AS (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey % 100 AS k FROM lineitem WHERE l_orderkey % 2 = 0),
seen AS (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey % 100 AS k FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT * FROM prior WHERE l_returnflag IN ('A', 'R') AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.l_suppkey = prior.l_suppkey AND s.l_returnflag = prior.l_returnflag AND s.k = prior.k)
""")
def q_disappearance(t: Tables) -> DataFrame:
    from cartulary.operators import publish

    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", (F.col("l_partkey") % 100).alias("k"))
    prior = rows.where("l_orderkey % 2 = 0").drop("l_orderkey").distinct()
    checked = t.lineitem.sparkSession.createDataFrame([("A",), ("R",)], "l_returnflag string")
    return publish.disappeared(prior, rows.where("l_orderkey % 2 = 1").drop("l_orderkey"), checked, ["l_suppkey", "k"], "l_returnflag")


@named("""
WITH o AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS rank, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) END AS quantity FROM lineitem),
d AS (SELECT l_partkey, rank, min(flag) AS flag, min(quantity) AS quantity FROM o GROUP BY 1, 2)
SELECT l_partkey, min_by(flag, rank) FILTER (WHERE flag IS NOT NULL) AS flag, min_by(quantity, rank) FILTER (WHERE quantity IS NOT NULL) AS quantity, min(rank) AS retained_rank FROM d GROUP BY 1
""")
def q_gap_fill(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("bigint")).alias("quantity"))
    one = rows.groupBy("l_partkey", "rank").agg(F.min("flag").alias("flag"), F.min("quantity").alias("quantity"))
    return resolve.fill_by_rank(one, ["l_partkey"], "rank", ["flag", "quantity"])


@named("""
SELECT l_partkey, l_linenumber, count(DISTINCT l_returnflag) AS n_lineages, min(l_suppkey) AS first_entity, min(l_suppkey) = max(l_suppkey) AS agree FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1
""")
def q_cross_source(t: Tables) -> DataFrame:
    return resolve.cross_source_same(t.lineitem, ["l_partkey", "l_linenumber"], "l_returnflag", "l_suppkey")
