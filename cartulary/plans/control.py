"""Run control: state machines, deadlines, budgets, selection, capacity, pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.plans.registry import Tables, named
from cartulary.streaming import control, pacing


@named("""
SELECT user_id, event_id, from_state, event_type AS to_state, from_state IN ('error', 'click') AND event_type = 'signup' AS illegal FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state IS NOT NULL
""")
def q_run_state(t: Tables) -> DataFrame:
    states = ["signup", "purchase", "error", "view", "click"]
    legal = [(a, b) for a in states for b in states if not (a in ("error", "click") and b == "signup")]
    return control.transitions(t.events, "user_id", ["ts", "event_id"], "event_type", legal).select("user_id", "event_id", "from_state", "to_state", "illegal")


@named("""
SELECT user_id, strftime(greatest(max(ts), max(ts) FILTER (WHERE event_type = 'error') + INTERVAL 2 HOUR) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS deadline,
  greatest(max(ts), max(ts) FILTER (WHERE event_type = 'error') + INTERVAL 2 HOUR) + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) AS stalled FROM events GROUP BY 1
""")
def q_stall(t: Tables) -> DataFrame:
    progress = t.events.groupBy("user_id").agg(F.max("ts").alias("progress"), (F.max(F.when(F.col("event_type") == "error", F.col("ts"))) + F.expr("INTERVAL 2 HOURS")).alias("retry"))
    now = t.events.agg(F.max("ts").alias("now"))
    rows = control.stalled(progress.crossJoin(F.broadcast(now)), ["progress", "retry"], "now", "INTERVAL 1 HOUR")
    return rows.select("user_id", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("deadline"), "stalled")


@named("""
SELECT event_type, event_id, CAST(cum AS BIGINT) AS charged, cum <= 20000 AS admitted FROM (
  SELECT event_type, event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS cum FROM events)
""")
def q_budget_admit(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "event_id", F.floor("value").alias("cost"))
    return control.admit(rows, "event_type", "event_id", F.col("cost"), 20_000).select("event_type", "event_id", "charged", "admitted")


@named("""
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'out_of_group' WHEN k <= 30 THEN 'selected' ELSE 'deferred' END AS decision FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)
""")
def q_selection(t: Tables) -> DataFrame:
    return control.select_first(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", ["BUILDING", "MACHINERY"], 30)


@named("SELECT event_type, count(DISTINCT user_id) AS n_requests, count(DISTINCT user_id) <= 150 AS within_capacity FROM events GROUP BY 1")
def q_capacity(t: Tables) -> DataFrame:
    return control.capacity(t.events, "event_type", "user_id", 150)


@named("""
WITH RECURSIVE signals AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(floor(value * 20) AS BIGINT) AS latency,
    CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 429 WHEN event_id % 4 = 1 THEN 500 WHEN event_id % 4 = 2 THEN 404 END AS status,
    event_type = 'error' AND event_id % 8 = 2 AS waits FROM events),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(500 AS BIGINT) AS i, CAST(8 AS BIGINT) AS c, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS r
  FROM (SELECT DISTINCT user_id FROM signals)
  UNION ALL
  SELECT user_id, k,
    CASE WHEN bad THEN least(60000, greatest(i * 2, i + 250)) WHEN recovers THEN greatest(500, i - 7438) ELSE i END,
    CASE WHEN bad THEN greatest(1, c // 2) WHEN recovers THEN least(8, c + 1) ELSE c END,
    CASE WHEN bad OR recovers OR (clean AND fastest) THEN 0 WHEN clean THEN n + 1 ELSE n END,
    CASE WHEN slow OR clean THEN coalesce((a * 8 + latency * 2 + 5) // 10, latency) ELSE a END,
    b + CAST(bad AS BIGINT), r + CAST(recovers AS BIGINT)
  FROM (SELECT *, clean AND NOT fastest AND n + 1 >= 20 AS recovers FROM (
    SELECT *, NOT bad AND status < 500 AS clean FROM (
      SELECT *, slow OR status IS NULL OR status = 429 OR waits AS bad FROM (
        SELECT f.user_id, s.k, i, c, n, a, b, r, status, latency, waits, i <= 500 AND c >= 8 AS fastest,
          coalesce(status < 400 AND latency > greatest(a * 4, a + 1000), false) AS slow
        FROM f JOIN signals s ON s.user_id = f.user_id AND s.k = f.k + 1)))))
SELECT user_id, max(k) AS n_signals, max_by(i, k) AS interval_ms, max_by(c, k) AS concurrency, max_by(n, k) AS clean,
  max(CASE WHEN last THEN a END) AS average_ms, max_by(b, k) AS backoffs, max_by(r, k) AS recoveries
FROM (SELECT *, k = max(k) OVER (PARTITION BY user_id) AS last FROM f) GROUP BY 1
""")
def q_pacing_fold(t: Tables) -> DataFrame:
    at = F.col("event_id")
    status = F.when(F.col("event_type") != "error", 200).when(at % 4 == 0, 429).when(at % 4 == 1, 500).when(at % 4 == 2, 404)
    waits = F.when((F.col("event_type") == "error") & (at % 8 == 2), 3000)
    signals = t.events.select("user_id", "ts", "event_id", status.alias("status"), F.floor(F.col("value") * 20).alias("latency_ms"), waits.alias("retry_after_ms"))
    return pacing.fold(signals, "user_id", ["ts", "event_id"])
