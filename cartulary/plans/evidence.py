"""Observations: freshness, coverage, decisions as of a time, digests, pages, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import dates
from cartulary.operators import evidence, publish, resolve
from cartulary.plans.registry import Tables, named
from cartulary.sources import html

_TS = "%Y-%m-%d %H:%M:%S.%f"


def _ts(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@named("SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, strftime(max(ts) FILTER (WHERE value > 50), '%Y-%m-%d %H:%M:%S.%f') AS last_active FROM events GROUP BY 1, 2")
def q_relationship_evidence(t: Tables) -> DataFrame:
    active = F.max(F.when(F.col("value") > 50, F.col("ts")))
    rows = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), active.alias("c"))
    return rows.select("user_id", "event_type", _ts("a").alias("first_seen"), _ts("b").alias("last_seen"), _ts("c").alias("last_active"))


@named("""
WITH h AS (SELECT event_type, ts >= TIMESTAMP '2024-01-11 00:00:00' AS later FROM events),
c AS (SELECT event_type, count(*) FILTER (WHERE NOT later) AS previous, count(*) FILTER (WHERE later) AS current FROM h GROUP BY 1),
x AS (SELECT *, greatest(25, CAST(ceil(previous * 2 / 10) AS BIGINT)) AS threshold FROM c)
SELECT event_type, previous, current, threshold,
  CASE WHEN previous - current >= threshold THEN 'blocked' WHEN current - previous >= threshold THEN 'warned' ELSE 'accepted' END AS verdict FROM x
""")
def q_coverage_delta(t: Tables) -> DataFrame:
    counted = lambda later: t.events.where((F.col("ts") >= F.expr("timestamp_ntz'2024-01-11 00:00:00'")) == later).groupBy("event_type").agg(F.count("*").alias("n"))
    return publish.coverage_change(counted(False), counted(True), "event_type", "n")


@named("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS checked_at, count(*) AS n_observations FROM events GROUP BY 1")
def q_freshness(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("ts").alias("m"), F.count("*").alias("n_observations")).select("event_type", _ts("m").alias("checked_at"), "n_observations")


@named("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS n_large, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def q_status_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("n_large"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


@named("SELECT l_partkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1 HAVING min(l_suppkey) <> max(l_suppkey)")
def q_minmax_consistency(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi")).where("lo <> hi")


@named("""
SELECT user_id % 50 AS request_key, event_type, count(*) AS n_requests, count(DISTINCT props) AS n_digests,
  CASE WHEN count(*) = 1 THEN 'first' WHEN count(DISTINCT props) = 1 THEN 'replayed' ELSE 'conflict' END AS outcome FROM events GROUP BY 1, 2
""")
def q_replay_dedupe(t: Tables) -> DataFrame:
    return evidence.replays(t.events.select((F.col("user_id") % 50).alias("request_key"), "event_type", "props"), ["request_key", "event_type"], "props")


@named("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'view') WHERE k = 1
""")
def q_latest_decision(t: Tables) -> DataFrame:
    pinned = t.events.where("ts <= timestamp_ntz'2024-01-20 00:00:00' and event_type <> 'view'").select("user_id", "ts", "event_id", "event_type")
    return resolve.latest(pinned, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@named("""
SELECT p.user_id, p.event_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S.%f') AS at,
  (SELECT max_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = p.user_id AND e.event_type IN ('signup', 'error') AND e.ts <= p.ts) AS erratum_id
FROM events p WHERE p.event_type = 'purchase'
""")
def q_asof_errata(t: Tables) -> DataFrame:
    purchases = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    errata = t.events.where("event_type in ('signup', 'error')").select("user_id", "ts", F.col("event_id").alias("erratum_id"))
    found = resolve.as_of(purchases, errata, "user_id", "ts", ["erratum_id"], F.date_trunc("day", "ts"))
    return found.select("user_id", "event_id", _ts("ts").alias("at"), F.col("asof_erratum_id").alias("erratum_id"))


@named("""
WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(event_id AS VARCHAR) || ':' || props AS line FROM events),
f AS (SELECT user_id, k, sha256('' || line) AS digest FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, sha256(f.digest || o.line) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, max(k) AS n_records, max_by(digest, k) AS digest FROM f GROUP BY 1
""")
def q_chained_digest(t: Tables) -> DataFrame:
    lines = t.events.select("user_id", "ts", "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("props")).alias("line"))
    return evidence.chained_digest(lines, ["user_id"], ["ts", "event_id"], "line")


@named(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS n_links,
  regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, strlen(html) AS n_bytes FROM pages
""")
def q_html_records(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.title("html").alias("title"), html.n_links("html").alias("n_links"), html.language("html").alias("lang"), F.octet_length("html").alias("n_bytes"))


@named("""
WITH d AS (SELECT o_orderkey, o_orderkey % 17 AS k, o_orderdate AS d, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
x AS (SELECT *, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN 'Q' || quarter(d) || ' ' || y WHEN 3 THEN y || ' (tentative)' WHEN 4 THEN 'TBA'
    WHEN 5 THEN strftime(d, '%B %-d, %Y') WHEN 6 THEN strftime(d, '%-d %B %Y') WHEN 7 THEN strftime(d, '%B, %Y') WHEN 8 THEN upper(strftime(d, '%B %Y')) WHEN 9 THEN 'Winter, ' || y
    WHEN 10 THEN 'fall ' || y WHEN 11 THEN y || ' Q' || quarter(d) WHEN 12 THEN strftime(d, '%B %-d, %Y') || ' (Subject to change)' WHEN 13 THEN strftime(d, '%B %-d %Y') || '  Pre-Sale at the Fair -Day 1-'
    WHEN 14 THEN '-' WHEN 15 THEN 'To be determined' ELSE y || '-02-30' END AS raw FROM d)
SELECT o_orderkey, raw,
  CASE WHEN k IN (0, 5, 6, 12, 13) THEN 'day' WHEN k IN (1, 7, 8) THEN 'month' WHEN k IN (2, 11) THEN 'quarter' WHEN k = 3 THEN 'year' WHEN k IN (9, 10) THEN 'season' WHEN k = 16 THEN 'invalid' ELSE 'unknown' END AS precision,
  CASE WHEN k IN (0, 5, 6, 12, 13) THEN strftime(d, '%Y-%m-%d') WHEN k IN (1, 7, 8) THEN strftime(d, '%Y-%m') WHEN k IN (2, 11) THEN y || '-Q' || quarter(d) WHEN k = 3 THEN y
    WHEN k = 9 THEN y || '-winter' WHEN k = 10 THEN y || '-autumn' END AS value,
  k IN (3, 12) AS tentative, CASE WHEN k = 13 THEN 'Pre-Sale at the Fair -Day 1-' END AS qualifier FROM x
""")
def q_release_date(t: Tables) -> DataFrame:
    """Dates in each form that publishers use, told apart and read."""
    d, year = F.col("o_orderdate"), F.date_format("o_orderdate", "yyyy")
    forms = [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM"), F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), year), F.concat(year, F.lit(" (tentative)")), F.lit("TBA"),
        F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMMM, yyyy"), F.upper(F.date_format(d, "MMMM yyyy")), F.concat(F.lit("Winter, "), year),
        F.concat(F.lit("fall "), year), F.concat(year, F.lit(" Q"), F.quarter(d)), F.date_format(d, "MMMM d, yyyy '(Subject to change)'"), F.date_format(d, "MMMM d yyyy'  Pre-Sale at the Fair -Day 1-'"),
        F.lit("-"), F.lit("To be determined"), F.concat(year, F.lit("-02-30")),
    ]
    rows = t.orders.select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms) + 1).cast("int")).alias("raw"))
    return rows.select("o_orderkey", "raw", dates.partial_date(F.col("raw")).alias("p")).select("o_orderkey", "raw", "p.*")


@named("""
SELECT conv_id, count(*) AS n_parts, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, sha256(string_agg(text, chr(10) ORDER BY turn)) AS body_sha256 FROM conversations GROUP BY 1
""")
def q_member_parts(t: Tables) -> DataFrame:
    return evidence.reassemble(t.conversations, "conv_id", "turn", "text")
