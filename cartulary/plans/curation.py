"""Queries of the owner's decisions: curated revisions, admissions, cards without a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.catalogue import admission, curated, reconcile
from cartulary.plans.registry import Tables, named

_SCHEMA = {
    "kind": "object", "fields": {
        "name": {"kind": "string", "required": True},
        "size": {"kind": "object", "required": True, "fields": {"unit": {"kind": "enum", "values": ["cm", "in"], "required": True}, "value": {"kind": "integer", "required": True}}},
    },
}


@named("""
WITH p AS (
  SELECT p_partkey AS k, p_brand AS game, p_name AS n, p_size AS s, p_partkey % 5 = 0 AS own, (p_partkey % 25 = 0 AND p_brand IN ('Brand#3', 'Brand#7')) AS changed, (p_partkey % 35 = 0 AND p_brand = 'Brand#12') AS bad FROM part),
b AS (SELECT game, bool_or((changed OR bad) AND own) AS blocked FROM p GROUP BY 1)
SELECT k AS id, p.game, '{"name":"' || CASE WHEN own AND NOT blocked THEN CASE WHEN k % 10 = 0 THEN 'twice ' ELSE 'curated ' END || n ELSE n END
  || '","size":{"unit":"' || CASE WHEN own AND NOT blocked AND k % 20 = 5 THEN 'in' ELSE 'cm' END || '","value":' || CASE WHEN own AND NOT blocked THEN s + 1 ELSE s END || '}}' AS content,
  CASE WHEN own THEN CASE WHEN blocked THEN 'blocked' ELSE 'patched' END ELSE 'official' END AS state,
  CASE WHEN own AND changed THEN 'source_changed:size-' || k WHEN own AND bad THEN 'unknown_value:$.size.unit' ELSE '' END AS problems, CASE WHEN own AND NOT blocked THEN 2 + CAST(k % 10 = 0 AS INTEGER) + CAST(k % 20 = 5 AS INTEGER) ELSE 0 END AS n_provenance
FROM p JOIN b ON b.game = p.game
""")
def q_curated_patches(t: Tables) -> DataFrame:
    """Records of parts with paths changed in order; games with a changed source value or an unknown unit are blocked whole."""
    k, game, name, size = (F.col(c) for c in ("p_partkey", "p_brand", "p_name", "p_size"))
    # Every ninth record still bears what an earlier run has laid over it.
    shown = F.when(k % 9 == 0, F.concat(F.lit("old "), name)).otherwise(name)
    content = F.to_json(F.struct(shown.alias("name"), F.struct(F.lit("cm").alias("unit"), size.alias("value")).alias("size")))
    trace = F.when(k % 9 == 0, F.to_json(F.array(F.struct(F.lit("/name").alias("path"), F.lit("r0").alias("revision"), name.alias("source")))))
    records = t.part.select(k.alias("id"), game.alias("game"), content.alias("content"), trace.alias("provenance"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    changed = (k % 25 == 0) & game.isin("Brand#3", "Brand#7")
    bad = (k % 35 == 0) & (game == "Brand#12")

    def one(ordinal: int, tag: str, path: str, value, seen, when) -> DataFrame:
        rows = t.part.where((k % 5 == 0) & when)
        return rows.select(game.alias("game"), k.alias("id"), F.lit(ordinal).alias("ordinal"), F.concat(F.lit(f"{tag}-"), k).alias("revision"), F.lit(path).alias("path"), value.alias("value"), F.sha2(seen, 256).alias("reviewed"))

    revisions = [
        one(1, "name", "/name", quoted(F.concat(F.lit("curated "), name)), quoted(name), F.lit(True)),
        one(2, "size", "/size/value", (size + 1).cast("string"), F.when(changed, F.lit("0.5")).otherwise(size.cast("string")), F.lit(True)),
        one(3, "again", "/name", quoted(F.concat(F.lit("twice "), name)), quoted(name), k % 10 == 0),
        one(4, "unit", "/size/unit", F.when(bad, F.lit('"ell"')).otherwise(F.lit('"in"')), F.lit('"cm"'), (k % 20 == 5) | bad),
    ]
    every = revisions[0]
    for more in revisions[1:]:
        every = every.unionAll(more)
    found = curated.apply_fields(records, every, _SCHEMA)
    entries = F.size(F.from_json("provenance", "array<struct<path:string>>"))
    return found.select("id", "game", "content", "state", F.array_join("problems", ",").alias("problems"), entries.alias("n_provenance"))


@named("""
WITH e AS (
  SELECT c_mktsegment AS game, c_custkey AS edge_id, CASE WHEN c_custkey % 13 = 0 THEN 'curated' END AS category, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 12 <> 0 ELSE c_acctbal > 0 END AS observed FROM customer),
official AS (SELECT * FROM e WHERE category IS NULL),
r AS (SELECT c_mktsegment AS game, c_custkey AS edge_id, CASE WHEN c_custkey % 8 = 0 THEN 'present' ELSE 'absent' END AS asserted, o.observed, o.edge_id IS NOT NULL AS there,
    CASE WHEN coalesce(o.observed, false) <> (c_mktsegment = 'BUILDING' AND c_custkey % 100 = 4) THEN 'present' ELSE 'absent' END AS seen FROM customer c LEFT JOIN official o ON o.edge_id = c_custkey WHERE c_custkey % 4 = 0),
x AS (SELECT *, seen <> CASE WHEN coalesce(observed, false) THEN 'present' ELSE 'absent' END AS conflict FROM r),
b AS (SELECT DISTINCT game FROM x WHERE conflict)
SELECT coalesce(o.game, x.game) AS game, coalesce(o.edge_id, x.edge_id) AS edge_id, CASE WHEN x.edge_id IS NOT NULL AND x.game NOT IN (SELECT game FROM b) THEN asserted = 'present' ELSE o.observed END AS observed,
  x.edge_id IS NOT NULL AND x.game NOT IN (SELECT game FROM b) AS curated, coalesce(conflict, false) AS conflict
FROM official o FULL JOIN x ON x.edge_id = o.edge_id WHERE o.edge_id IS NOT NULL OR x.game NOT IN (SELECT game FROM b)
""")
def q_curated_edges(t: Tables) -> DataFrame:
    """Customers as edges that the owner asserts or denies; one segment has met another presence than was reviewed."""
    k, game = F.col("c_custkey"), F.col("c_mktsegment")
    reviewed = F.when(k % 6 == 0, F.when(k % 12 != 0, "present").otherwise("absent"))
    edges = t.customer.select(game.alias("game"), k.alias("edge_id"), (F.col("c_acctbal") > 0).alias("observed"), reviewed.alias("reviewed"), F.when(k % 13 == 0, "curated").alias("category"))
    now = F.when(k % 13 == 0, False).when(k % 6 == 0, k % 12 != 0).otherwise(F.col("c_acctbal") > 0)
    seen = now != ((game == "BUILDING") & (k % 100 == 4))
    revisions = t.customer.where("c_custkey % 4 = 0").select(game.alias("game"), k.alias("edge_id"), F.when(k % 8 == 0, "present").otherwise("absent").alias("asserted"), F.when(seen, "present").otherwise("absent").alias("reviewed"))
    return curated.apply_relationships(edges, revisions)


_ACTION = "CASE WHEN event_type = 'view' THEN 'admit' WHEN event_type = 'click' THEN 'reject' WHEN event_type = 'error' THEN 'link' WHEN event_type = 'purchase' THEN 'admit' ELSE 'reconsider' END"


@named(f"""
WITH RECURSIVE l AS (
  SELECT user_id AS proposal_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {_ACTION} AS action, event_id % 9 AS jitter, CAST(event_id % 4 AS VARCHAR) AS key, CASE WHEN value > 90 THEN 'new' END AS content FROM events),
f AS (
  SELECT proposal_id, CAST(0 AS BIGINT) AS seq, '' AS outcome, CAST(0 AS BIGINT) AS generation, 'unresolved' AS status, CAST([] AS STRUCT(k VARCHAR, r VARCHAR)[]) AS keys FROM (SELECT DISTINCT proposal_id FROM l)
  UNION ALL
  SELECT proposal_id, seq, outcome, generation + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END,
    CASE WHEN outcome <> 'applied' THEN status WHEN action IN ('admit', 'link') THEN 'admitted' WHEN action = 'reject' THEN 'rejected' ELSE 'unresolved' END,
    CASE WHEN outcome = 'applied' THEN list_append(keys, {{'k': key, 'r': request}}) ELSE keys END
  FROM (SELECT *, CASE WHEN sent IS NOT NULL THEN CASE WHEN sent = request THEN 'replay' ELSE 'conflict' END WHEN expected <> generation THEN 'lost_update'
      WHEN NOT (status = 'unresolved' OR action = 'reconsider' OR (status = 'rejected' AND action = 'reject')) THEN 'illegal_step' WHEN content IS NOT NULL AND action <> 'reconsider' THEN 'misplaced_content' ELSE 'applied' END AS outcome FROM (
    SELECT *, list_filter(keys, lambda x: x.k = key)[1].r AS sent FROM (
      SELECT f.proposal_id, l.seq, f.generation, f.status, f.keys, l.action, l.content, l.jitter, 'k' || f.proposal_id || '-' || l.key || '-' || (l.seq // 8) AS key, (l.seq + l.jitter // 5) // 9 AS expected,
        l.action || ((l.seq + l.jitter // 5) // 9) || coalesce(l.content, '-') AS request
      FROM f JOIN l ON l.proposal_id = f.proposal_id AND l.seq = f.seq + 1))))
SELECT proposal_id, seq, outcome, generation, status FROM f WHERE seq > 0
""")
def q_admission_log(t: Tables) -> DataFrame:
    """Events as an owner's requests on proposals (users): lost updates, illegal steps and replays come out as rows."""
    rows = t.events.withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    action = F.when(F.col("event_type").isin("view", "purchase"), "admit").when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "error", "link").otherwise("reconsider")
    expected = F.floor((F.col("seq") + F.floor(F.col("event_id") % 9 / 5)) / 9)
    key = F.concat(F.lit("k"), "user_id", F.lit("-"), F.col("event_id") % 4, F.lit("-"), F.floor(F.col("seq") / 8))
    return admission.decide(rows.select(F.col("user_id").alias("proposal_id"), "seq", action.alias("action"), expected.alias("expected"), key.alias("key"), F.when(F.col("value") > 90, "new").alias("content")))


@named("""
WITH o AS (
  SELECT l_orderkey AS e, l_returnflag AS lineage, {'flag': l_linestatus, 'line': CAST(l_linenumber AS VARCHAR), 'qty': CASE WHEN l_quantity < 5 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END} AS f, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x FROM lineitem WHERE l_returnflag <> 'N'),
k AS (SELECT o_orderkey AS e, o_orderstatus AS flag, CAST(o_orderkey % 7 + 1 AS VARCHAR) AS line, CAST(o_orderkey % 50 AS VARCHAR) AS qty FROM orders)
SELECT o.e AS entity_id, lineage, p, s, x,
  array_to_string(list_filter([CASE WHEN f.flag = k.flag THEN 'flag' END, CASE WHEN f.line = k.line THEN 'line' END, CASE WHEN f.qty = k.qty AND o.e % 3 <> 0 THEN 'qty' END], lambda v: v IS NOT NULL), ',') AS confirmed,
  array_to_string(list_filter([CASE WHEN f.flag <> k.flag THEN 'flag' END, CASE WHEN f.line <> k.line THEN 'line' END, CASE WHEN f.qty <> k.qty AND o.e % 3 <> 0 THEN 'qty' END], lambda v: v IS NOT NULL), ',') AS differing
FROM o JOIN k ON k.e = o.e
""")
def q_publisher_confirmation(t: Tables) -> DataFrame:
    """Lines as a publisher's evidence on orders: which fields it confirms, which differ."""
    word = lambda c: F.col(c).cast("int").cast("string")
    fields = F.create_map(F.lit("flag"), F.col("l_linestatus"), F.lit("line"), word("l_linenumber"), F.lit("qty"), F.when(F.col("l_quantity") >= 5, word("l_quantity")))
    observed = t.lineitem.select(F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("lineage"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("x"), fields.alias("fields"))
    k = F.col("o_orderkey")
    known = F.map_from_entries(F.filter(F.array(F.struct(F.lit("flag").alias("k"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("line").alias("k"), (k % 7 + 1).cast("string").alias("v")), F.struct(F.when(k % 3 != 0, "qty").alias("k"), (k % 50).cast("string").alias("v"))), lambda e: e["k"].isNotNull()))
    accepted = t.orders.select(k.alias("entity_id"), known.alias("fields"))
    publishers = t.lineitem.select(F.col("l_returnflag").alias("lineage")).where("lineage <> 'N'").distinct()
    found = admission.confirmed_fields(observed, accepted, publishers)
    return found.withColumns({"confirmed": F.array_join("confirmed", ","), "differing": F.array_join("differing", ",")})


@named("""
WITH o AS (
  SELECT o_orderkey AS observation_id, 'g' || (o_custkey % 3) AS game, CASE WHEN o_orderkey % 3 <> 0 THEN 'number' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS value, 'f' || (o_custkey % 400) AS facts, o_orderstatus AS lineage, CAST(o_custkey // 2 AS VARCHAR) AS design FROM orders),
p AS (
  SELECT 'card-' || c_custkey AS card_id, 'g' || (c_custkey % 3) AS game, CASE WHEN c_custkey % 2 = 0 THEN 'number' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS value, 'f' || (c_custkey % 400) AS facts FROM customer WHERE c_custkey % 400 < 300),
adm AS (SELECT o_orderkey AS observation_id, 'admitted-' || o_orderkey AS card_id FROM orders WHERE o_orderkey % 101 = 0),
rev AS (SELECT o_orderkey AS observation_id, 'reviewed-' || o_orderkey AS card_id FROM orders WHERE o_orderkey % 37 = 0),
prf AS (SELECT DISTINCT l_orderkey AS observation_id, 'card-' || (o_custkey + 400 * (l_linenumber % 2)) AS card_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40),
known AS (SELECT game, kind, value, min(card_id) AS known_id FROM p WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
equal AS (SELECT game, facts, min(card_id) AS equal_id FROM p WHERE kind IS NULL GROUP BY 1, 2),
proven AS (SELECT o.observation_id, min(x.card_id) AS lo, max(x.card_id) AS hi FROM o JOIN prf x ON x.observation_id = o.observation_id JOIN p ON p.card_id = x.card_id AND p.kind IS NULL AND p.game = o.game AND p.facts = o.facts WHERE o.kind IS NULL GROUP BY 1),
firsts AS (SELECT game, kind, value, min(observation_id) AS first_id FROM o WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
j AS (
  SELECT o.*, a.card_id AS admitted_id, r.card_id AS review_id, k.known_id, e.equal_id, lo, hi, first_id,
    CASE WHEN a.card_id IS NOT NULL THEN 'admission' WHEN o.kind IS NOT NULL AND known_id IS NOT NULL THEN 'published' WHEN o.kind IS NOT NULL AND first_id <> o.observation_id THEN 'same_run' WHEN o.kind IS NOT NULL THEN 'allocated'
      WHEN lo = hi THEN 'equal_facts' WHEN equal_id IS NOT NULL AND r.card_id IS NOT NULL THEN 'reviewed' WHEN equal_id IS NOT NULL THEN 'unproven' ELSE 'allocated' END AS how
  FROM o LEFT JOIN adm a ON a.observation_id = o.observation_id LEFT JOIN rev r ON r.observation_id = o.observation_id LEFT JOIN known k ON k.game = o.game AND k.kind = o.kind AND k.value = o.value
  LEFT JOIN equal e ON e.game = o.game AND e.facts = o.facts LEFT JOIN proven v ON v.observation_id = o.observation_id LEFT JOIN firsts f ON f.game = o.game AND f.kind = o.kind AND f.value = o.value)
SELECT observation_id, how, CASE WHEN how = 'unproven' THEN 'canonical_card_conflict' END AS diagnostic,
  CASE WHEN how = 'admission' THEN admitted_id WHEN how = 'published' THEN known_id WHEN kind IS NOT NULL THEN 'card_' || sha256(game || chr(31) || kind || chr(31) || value) WHEN how = 'equal_facts' THEN lo WHEN how = 'reviewed' THEN review_id WHEN how = 'unproven' THEN equal_id
    ELSE 'card_' || sha256(game || chr(31) || lineage || chr(31) || design) END AS card_id
FROM j
""")
def q_unnumbered_cards(t: Tables) -> DataFrame:
    """Orders as observations, a third of them without a number; proofs are large lines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    numbered = k % 3 != 0
    observations = t.orders.select(
        k.alias("observation_id"), F.concat(F.lit("g"), c % 3).alias("game"), F.when(numbered, "number").alias("kind"), F.when(numbered, c.cast("string")).alias("value"),
        F.concat(F.lit("f"), c % 400).alias("facts"), F.col("o_orderstatus").alias("lineage"), F.expr("o_custkey div 2").cast("string").alias("design"),
    )
    x = F.col("c_custkey")
    even = x % 2 == 0
    published = t.customer.where("c_custkey % 400 < 300").select(F.concat(F.lit("card-"), x).alias("card_id"), F.concat(F.lit("g"), x % 3).alias("game"), F.when(even, "number").alias("kind"), F.when(even, x.cast("string")).alias("value"), F.concat(F.lit("f"), x % 400).alias("facts"))
    named_by = lambda prefix, m: t.orders.where(k % m == 0).select(k.alias("observation_id"), F.concat(F.lit(prefix), k).alias("card_id"))
    lines = t.lineitem.where("l_quantity > 40").join(t.orders, F.col("l_orderkey") == k)
    proofs = lines.select(k.alias("observation_id"), F.concat(F.lit("card-"), c + 400 * (F.col("l_linenumber") % 2)).alias("card_id"))
    return reconcile.resolve_with_proof(observations, named_by("admitted-", 101), published, proofs, named_by("reviewed-", 37))
