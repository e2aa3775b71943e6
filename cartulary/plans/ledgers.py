"""Queries of budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.plans.registry import Tables, named
from cartulary.streaming import ledger

NOW = 1_000_000_000


@named(f"""
WITH RECURSIVE numbered AS (SELECT user_id AS run_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
ev AS (
  SELECT run_id, seq, event_id AS moment, CASE WHEN seq = 1 + run_id % 3 THEN 'policy' WHEN event_type IN ('view', 'click', 'error') THEN 'reserve' ELSE 'settle' END AS kind,
    1 + event_id % 5 AS slot, CAST(floor(value * 100) AS BIGINT) AS size, 8 + run_id % 20 AS max_d, 100000 AS max_b, 6000 + run_id % 7 * 1000 AS deadline FROM numbered),
f AS (
  SELECT run_id, CAST(0 AS BIGINT) AS seq, false AS has, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS r, CAST([NULL, NULL, NULL, NULL, NULL] AS BIGINT[]) AS held, '' AS decision, CAST(NULL AS VARCHAR) AS dimension, CAST(-1 AS BIGINT) AS moment
  FROM (SELECT DISTINCT run_id FROM ev)
  UNION ALL
  SELECT run_id, seq, has OR kind = 'policy', d + CASE WHEN grants THEN 1 ELSE 0 END, c + CASE WHEN settles THEN size ELSE 0 END, r + CASE WHEN grants THEN size WHEN settles THEN -held[slot] ELSE 0 END,
    CASE WHEN grants OR settles THEN list_concat(held[1 : slot - 1], [CASE WHEN grants THEN size END], held[slot + 1 :]) ELSE held END,
    CASE WHEN kind = 'policy' THEN 'policy' WHEN grants THEN 'granted' WHEN settles THEN 'settled' WHEN kind = 'settle' THEN 'ignored' ELSE 'paused' END, dim, moment
  FROM (SELECT *, kind = 'reserve' AND dim IS NULL AS grants, kind = 'settle' AND held[slot] IS NOT NULL AS settles FROM (
    SELECT f.run_id, e.seq, f.has, f.d, f.c, f.r, f.held, e.kind, e.slot, e.size, e.moment,
      CASE WHEN e.kind <> 'reserve' THEN NULL WHEN f.held[e.slot] IS NOT NULL THEN 'ownership' WHEN NOT f.has THEN 'policy_missing' WHEN e.moment >= e.deadline THEN 'deadline' WHEN f.d >= e.max_d THEN 'dispatches' WHEN e.size > e.max_b - f.c - f.r THEN 'source_bytes' END AS dim
    FROM f JOIN ev e ON e.run_id = f.run_id AND e.seq = f.seq + 1))),
closing AS (SELECT run_id, max(deadline) AS deadline, max(CASE WHEN kind = 'policy' THEN moment END) AS policy_at FROM ev GROUP BY 1)
SELECT run_id, seq, decision, dimension, d AS charged_dispatches, c AS charged_bytes, r AS reserved_bytes, CAST(len(list_filter(held, lambda x: x IS NOT NULL)) AS BIGINT) AS n_open FROM f WHERE seq > 0
UNION ALL
SELECT f.run_id, NULL, 'closed', 'deadline', max_by(d, seq), max_by(c, seq), max_by(r, seq), max_by(CAST(len(list_filter(held, lambda x: x IS NOT NULL)) AS BIGINT), seq)
FROM f JOIN closing k ON k.run_id = f.run_id WHERE k.policy_at IS NOT NULL AND f.moment < greatest(k.deadline, k.policy_at + 1) GROUP BY 1
""")
def q_budget_ledger(t: Tables) -> DataFrame:
    """Events as reservations and settlements of their users' budgets."""
    run, seq = F.col("user_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.withColumn("seq", seq)
    policy = F.col("seq") == 1 + run % 3
    kind = F.when(policy, "policy").when(F.col("event_type").isin("view", "click", "error"), "reserve").otherwise("settle")
    events = rows.select(
        run.alias("run_id"), "seq", F.col("event_id").alias("at"), kind.alias("kind"), (F.col("event_id") % 5).cast("string").alias("id"), F.floor(F.col("value") * 100).alias("bytes"),
        F.when(policy, 8 + run % 20).alias("max_dispatches"), F.when(policy, 100_000).alias("max_bytes"), F.when(policy, 6000 + run % 7 * 1000).alias("deadline"),
    )
    return ledger.settle(events, NOW)
