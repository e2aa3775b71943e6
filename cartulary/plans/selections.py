"""Queries of source selection, errata targets and histories over revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import errata, selection
from cartulary.operators import publish
from cartulary.operators.lineage import written
from cartulary.plans.registry import Tables, named

_YEARS = (1997, 1998, 1999, 2000)


def _told(prefix: str) -> str:
    years = ", ".join(f"({y})" for y in _YEARS)
    return f"{prefix} AS (SELECT DISTINCT l_partkey AS card, l_returnflag AS fact, year(l_shipdate) AS y FROM lineitem WHERE l_quantity < 8 AND year(l_shipdate) IN (SELECT * FROM (VALUES {years}) AS t(y)))"


@named(f"""
WITH {_told("told")},
grid AS (SELECT c.card, y.y FROM (SELECT card, min(y) AS since FROM told GROUP BY 1) AS c JOIN (VALUES {", ".join(f"({y})" for y in _YEARS)}) AS y(y) ON y.y >= c.since),
state AS (SELECT card, fact, y, false AS missing FROM told UNION ALL SELECT card, NULL, y, true FROM grid WHERE (card, y) NOT IN (SELECT card, y FROM told)),
runs AS (SELECT *, y - row_number() OVER (PARTITION BY card, fact, missing ORDER BY y) AS run FROM state)
SELECT card, fact, min(y) AS first_revision, max(y) AS last_revision, max(y) = {_YEARS[-1]} AS current, missing FROM runs GROUP BY card, fact, missing, run
""")
def q_history_merge(t: Tables) -> DataFrame:
    """Spans of what small lines tell of each part, extended by one year after the other."""
    rows = t.lineitem.where("l_quantity < 8").select(F.col("l_partkey").alias("card"), F.col("l_returnflag").alias("fact"), F.year("l_shipdate").alias("y"))
    history = t.part.sparkSession.createDataFrame([], "card bigint, fact string, first_revision bigint, last_revision bigint, current boolean, missing boolean")
    for year in _YEARS:
        history = written(publish.extend_history(history, rows.where(F.col("y") == year), ["card"], "fact", year))
    return history


@named("""
WITH parsed AS (
  SELECT event_id AS observation_id, event_type AS lineage, 'g' || (user_id % 3) AS game, CASE WHEN event_id % 5 = 0 THEN 'printing' ELSE 'card' END AS target_type, 'Customer#' || lpad(CAST(user_id * 7 % 1600 AS VARCHAR), 9, '0') AS name,
    CASE WHEN event_id % 3 = 0 THEN 'n' || (user_id % 120) END AS number, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS effective_from, props AS value FROM events),
cards AS (SELECT 'card-' || c_custkey AS card_id, 'g' || (c_custkey % 3) AS game, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'n' || (c_custkey % 120) END AS number FROM customer WHERE c_custkey < 130 OR c_custkey % 4 = 1),
printings AS (SELECT o_orderkey AS observation_id, min('printing-' || o_orderkey) AS printing_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
nums AS (SELECT game, number, count(*) AS n, min(card_id) AS id FROM cards WHERE number IS NOT NULL GROUP BY 1, 2),
names AS (SELECT game, name, count(*) AS n, min(card_id) AS id FROM cards GROUP BY 1, 2),
j AS (
  SELECT p.*, r.printing_id, coalesce(CASE WHEN p.number IS NOT NULL THEN a.n ELSE b.n END, 0) AS n, CASE WHEN p.number IS NOT NULL THEN a.id ELSE b.id END AS id
  FROM parsed p LEFT JOIN nums a ON a.game = p.game AND a.number = p.number LEFT JOIN names b ON b.game = p.game AND b.name = p.name LEFT JOIN printings r ON r.observation_id = p.observation_id),
k AS (SELECT *, CASE WHEN target_type = 'printing' THEN CASE WHEN printing_id IS NULL THEN 'printing_not_accepted' END WHEN n = 0 THEN 'unknown_target' WHEN n > 1 THEN 'ambiguous_target' END AS problem FROM j)
SELECT observation_id, lineage, target_type, problem, CASE WHEN problem IS NULL THEN CASE WHEN target_type = 'printing' THEN printing_id ELSE id END END AS target_id, effective_from FROM k
""")
def q_errata_targets(t: Tables) -> DataFrame:
    """Events as corrections of customers (cards) by number or name, or of accepted printings."""
    e, u = F.col("event_id"), F.col("user_id")
    parsed = t.events.select(
        e.alias("observation_id"), F.col("event_type").alias("lineage"), F.concat(F.lit("g"), u % 3).alias("game"), F.when(e % 5 == 0, "printing").otherwise("card").alias("target_type"),
        F.concat(F.lit("Customer#"), F.lpad((u * 7 % 1600).cast("string"), 9, "0")).alias("name"), F.when(e % 3 == 0, F.concat(F.lit("n"), u % 120)).alias("number"),
        F.when(e % 4 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("effective_from"), F.lit("w").alias("wording"), F.col("props").alias("value"),
    )
    c = F.col("c_custkey")
    cards = t.customer.where("c_custkey < 130 or c_custkey % 4 = 1").select(F.concat(F.lit("card-"), c).alias("card_id"), F.concat(F.lit("g"), c % 3).alias("game"), F.col("c_name").alias("name"), F.when(c % 2 == 0, F.concat(F.lit("n"), c % 120)).alias("number"))
    printings = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("observation_id"), F.concat(F.lit("printing-"), "o_orderkey").alias("printing_id"))
    return errata.identified(parsed, cards, printings).select("observation_id", "lineage", "target_type", "problem", "target_id", "effective_from")


@named("""
WITH e AS (
  SELECT 'e' || (l_partkey % 500) AS erratum_id, l_partkey % 500 AS target_id, CASE WHEN l_partkey % 3 = 0 THEN '2020-01-01' END AS effective_from, CASE WHEN l_partkey % 490 = 7 AND l_quantity > 48 THEN l_linestatus ELSE 'v' END AS value, l_returnflag AS lineage FROM lineitem)
SELECT erratum_id, first(target_id ORDER BY target_id, effective_from NULLS FIRST, value) AS target_id, first(effective_from ORDER BY target_id, effective_from NULLS FIRST, value) AS effective_from, first(value ORDER BY target_id, effective_from NULLS FIRST, value) AS value,
  array_to_string(list_sort(list(DISTINCT lineage)), ',') AS lineages, count(DISTINCT (target_id, coalesce(effective_from, ''), value)) > 1 AS conflict FROM e GROUP BY 1
""")
def q_errata_merge(t: Tables) -> DataFrame:
    """Lines as errata told before (R and A) and now (N)."""
    k = F.col("l_partkey")
    value = F.when((k % 490 == 7) & (F.col("l_quantity") > 48), F.col("l_linestatus")).otherwise("v")
    rows = t.lineitem.select(F.concat(F.lit("e"), k % 500).alias("erratum_id"), (k % 500).alias("target_id"), F.when(k % 3 == 0, "2020-01-01").alias("effective_from"), F.lit("w").alias("wording"), value.alias("value"), F.col("l_returnflag").alias("lineage"))
    return errata.merged(rows.where("lineage <> 'N'"), rows.where("lineage = 'N'")).withColumn("lineages", F.array_join("lineages", ","))


_LINEAGES = """
plans AS (
  SELECT DISTINCT p_type AS lineage, CASE WHEN length(p_type) % 2 = 0 THEN 'optional' ELSE 'required' END AS participation, 'g' || (length(p_type) % 3) AS game, 'en' AS locale, CASE WHEN p_type < 'M' THEN 'eu' ELSE 'us' END AS region,
    CASE WHEN p_type < 'N' THEN ['catalogue', 'errata'] ELSE ['catalogue'] END AS areas FROM part),
requests AS (
  SELECT p.p_type AS lineage, CASE WHEN l_linenumber = 1 THEN 'image' ELSE 'detail' END AS role, CASE WHEN l_quantity > 49 AND (p_type <> 'PROMO' OR l_linenumber = 1) AND p_type <> 'STANDARD' THEN 'failed' ELSE 'done' END AS state,
    CASE WHEN p_type = 'MEDIUM' OR (length(p_type) % 2 = 0 AND p_type <> 'LARGE' AND l_partkey % 2 = 0) THEN 'bad_shape' ELSE 'timeout' END AS code FROM lineitem JOIN part p ON p_partkey = l_partkey)
"""


@named(f"""
WITH {_LINEAGES.strip()},
sums AS (SELECT lineage, bool_or(state = 'failed' AND role <> 'image' AND code = 'timeout') AS outage, bool_or(state = 'failed' AND role <> 'image' AND code <> 'timeout') AS bad FROM requests GROUP BY 1),
judged AS (SELECT p.*, outage, CASE WHEN participation = 'optional' AND outage AND NOT bad THEN 'omitted' WHEN outage OR bad THEN 'blocked' ELSE 'collected' END AS outcome FROM plans p JOIN sums s ON s.lineage = p.lineage),
decisions AS (SELECT game, area, locale, region, max_by(lineage, sequence) AS authority FROM (
  SELECT 'g' || (s_suppkey % 3) AS game, CASE WHEN s_suppkey % 2 = 0 THEN 'catalogue' ELSE 'errata' END AS area, 'en' AS locale, CASE WHEN s_nationkey % 2 = 0 THEN 'eu' ELSE 'us' END AS region, ['PROMO', 'STANDARD', 'LARGE', 'nobody'][1 + s_suppkey % 4] AS lineage, s_suppkey AS sequence FROM supplier) GROUP BY 1, 2, 3, 4),
collected AS (SELECT game, area, locale, region, list(DISTINCT lineage) AS applicable FROM (SELECT lineage, game, unnest(areas) AS area, locale, region FROM judged WHERE NOT (participation = 'optional' AND outage)) GROUP BY 1, 2, 3, 4)
SELECT 'lineage' AS kind, lineage AS subject, outcome FROM judged
UNION ALL SELECT 'authority', concat_ws('/', d.game, d.area, d.locale, d.region, authority), CASE WHEN len(list_filter(applicable, lambda x: x >= 'M')) = 0 THEN 'unchanged' ELSE 'missing' END
FROM decisions d JOIN collected c ON c.game = d.game AND c.area = d.area AND c.locale = d.locale AND c.region = d.region WHERE NOT list_contains(applicable, authority)
""")
def q_selected_sources(t: Tables) -> DataFrame:
    """Types of parts as lineages, their lines as requests, suppliers as decisions on authorities."""
    kind, size = F.col("p_type"), F.char_length("p_type")
    plans = t.part.select(
        kind.alias("lineage"), F.when(size % 2 == 0, "optional").otherwise("required").alias("participation"), F.concat(F.lit("g"), size % 3).alias("game"), F.lit("en").alias("locale"), F.when(kind < "M", "eu").otherwise("us").alias("region"),
        F.when(kind < "N", F.array(F.lit("catalogue"), F.lit("errata"))).otherwise(F.array(F.lit("catalogue"))).alias("areas"),
    ).distinct()
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    first = F.col("l_linenumber") == 1
    failed = (F.col("l_quantity") > 49) & ((kind != "PROMO") | first) & (kind != "STANDARD")
    bad = (kind == "MEDIUM") | ((size % 2 == 0) & (kind != "LARGE") & (F.col("l_partkey") % 2 == 0))
    requests = lines.select(kind.alias("lineage"), F.when(first, "image").otherwise("detail").alias("role"), F.when(failed, "failed").otherwise("done").alias("state"), F.when(bad, "bad_shape").otherwise("timeout").alias("code"))
    s = F.col("s_suppkey")
    who = F.array(*[F.lit(x) for x in ("PROMO", "STANDARD", "LARGE", "nobody")])
    decisions = t.supplier.select(F.concat(F.lit("g"), s % 3).alias("game"), F.when(s % 2 == 0, "catalogue").otherwise("errata").alias("area"), F.lit("en").alias("locale"), F.when(F.col("s_nationkey") % 2 == 0, "eu").otherwise("us").alias("region"), F.get(who, (s % 4).cast("int")).alias("lineage"), s.alias("sequence"))
    unchanged = plans.select("lineage", (F.col("lineage") < "M").alias("unchanged"))
    return selection.selected_sources(requests, plans, decisions, unchanged)


@named("""
WITH RECURSIVE cand AS (SELECT c_custkey AS id, 'g' || (c_custkey % 5) AS game, CASE WHEN c_custkey >= 5 THEN c_custkey - 5 END AS predecessor FROM customer),
heads AS (SELECT max(id) AS id FROM cand GROUP BY game),
sel AS (SELECT o_custkey AS candidate, o_orderpriority AS lineage, CASE WHEN o_custkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS adapter, o_orderkey % 4 AS request_id, CASE WHEN o_orderkey % 4 = 3 THEN 'image' ELSE 'detail' END AS role, max(CASE WHEN o_totalprice > 400000 THEN 'x' ELSE 'd' END) AS digest
  FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL),
cur AS (SELECT DISTINCT 'g' || (s_suppkey % 5) AS game, o_orderpriority AS lineage, 'v2' AS adapter, r.r AS request_id, CASE WHEN r.r = 3 THEN 'image' ELSE 'detail' END AS role, 'd' AS digest FROM supplier, (SELECT DISTINCT o_orderpriority FROM orders), (VALUES (0), (1), (2), (3)) AS r(r) WHERE (s_suppkey % 5 + r.r) % 3 < 2),
walk(id, game, round) AS (SELECT c.predecessor, c.game, 0 FROM cand c JOIN heads h ON h.id = c.id UNION ALL SELECT c.predecessor, w.game, w.round + 1 FROM walk w JOIN cand c ON c.id = w.id WHERE c.predecessor IS NOT NULL),
facts AS (SELECT s.*, w.game, w.round FROM sel s JOIN walk w ON w.id = s.candidate WHERE role <> 'image'),
near AS (SELECT game, lineage, first(candidate ORDER BY round, candidate) AS candidate FROM facts GROUP BY 1, 2),
acc AS (SELECT f.game, f.lineage, f.candidate, f.request_id, f.adapter AS old_adapter, f.digest AS old FROM facts f JOIN near n ON n.game = f.game AND n.lineage = f.lineage AND n.candidate = f.candidate),
both_ AS (SELECT game, lineage, request_id, candidate, old_adapter, old, c.adapter, c.digest FROM acc FULL JOIN (SELECT * FROM cur WHERE role <> 'image') c USING (game, lineage, request_id))
SELECT game, lineage, max(adapter) AS adapter, max(candidate) AS accepted_in, count(old_adapter) AS n_accepted, bool_and(old IS NOT DISTINCT FROM digest AND old_adapter IS NOT DISTINCT FROM adapter) AND count(old_adapter) > 0 AS unchanged
FROM both_ GROUP BY 1, 2 HAVING max(adapter) IS NOT NULL
""")
def q_unchanged_lineages(t: Tables) -> DataFrame:
    """Customers as a chain of candidates for each game, their orders as accepted evidence; is what suppliers show now the same?"""
    c = F.col("c_custkey")
    candidates = t.customer.select(c.alias("id"), F.concat(F.lit("g"), c % 5).alias("game"), F.when(c >= 5, c - 5).alias("predecessor"))
    heads = candidates.groupBy("game").agg(F.max("id").alias("id")).select("id")
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    role = lambda x: F.when(x == 3, "image").otherwise("detail")
    told = t.orders.where("o_custkey % 3 = 0").select(k.alias("candidate"), F.col("o_orderpriority").alias("lineage"), F.when(k % 11 == 0, "v1").otherwise("v2").alias("adapter"), (o % 4).alias("request_id"), role(o % 4).alias("role"), F.when(F.col("o_totalprice") > 400_000, "x").otherwise("d").alias("digest"))
    selections = told.groupBy("candidate", "lineage", "adapter", "request_id", "role").agg(F.max("digest").alias("digest"))
    games = t.supplier.select((F.col("s_suppkey") % 5).alias("g")).distinct()
    lineages = F.array_sort(F.collect_set("o_orderpriority"))
    every = t.orders.agg(lineages.alias("lineages"))  # a bounded set of priorities
    rows = games.join(F.broadcast(every)).select("g", F.explode("lineages").alias("lineage")).select("g", "lineage", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    shown = rows.where((F.col("g") + F.col("r")) % 3 < 2).select(F.concat(F.lit("g"), "g").alias("game"), "lineage", F.lit("v2").alias("adapter"), F.col("r").cast("bigint").alias("request_id"), role(F.col("r")).alias("role"), F.lit("d").alias("digest"))
    return selection.unchanged_lineages(candidates, heads, selections, shown)
