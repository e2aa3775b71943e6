"""Queries of the reconciliation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import reconcile
from cartulary.operators import evidence
from cartulary.operators.lineage import tabled
from cartulary.plans.registry import Tables, named
from cartulary.streaming import control


def _printings(t: Tables) -> DataFrame:
    cols = {"card_id": F.col("l_partkey"), "artwork": F.col("l_suppkey") % 7, "printed_digest": F.col("l_linenumber"), "rarity": F.col("l_returnflag"), "treatment": F.nullif(F.col("l_linestatus"), F.lit("O"))}
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    return tabled(t.lineitem.select(*key).distinct()).select("l_orderkey", F.concat_ws("-", *[F.col(k).cast("string") for k in key]).alias("id"), (F.col("l_orderkey") % 3).cast("string").alias("lineage"), *[c.alias(n) for n, c in cols.items()])


@named("""
WITH a AS (SELECT DISTINCT l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS id, CAST(l_orderkey % 3 AS VARCHAR) AS lineage, l_partkey AS card_id, l_suppkey % 7 AS artwork,
    l_linenumber AS printed_digest, l_returnflag AS rarity, nullif(l_linestatus, 'O') AS treatment FROM lineitem),
p AS (SELECT * FROM a WHERE l_orderkey % 2 = 0), o AS (SELECT * FROM a WHERE l_orderkey % 2 = 1),
x AS (SELECT o.*, (SELECT max(p.id) FROM p WHERE p.lineage = o.lineage AND o.l_orderkey % 5 = 0 AND p.card_id = o.card_id AND p.printed_digest = o.printed_digest) AS loc,
  CASE WHEN o.l_orderkey % 11 = 0 THEN 'reviewed' END AS rev,
  (SELECT count(*) FROM p WHERE p.card_id = o.card_id AND p.artwork = o.artwork AND p.printed_digest = o.printed_digest AND p.rarity = o.rarity AND p.treatment IS NOT DISTINCT FROM o.treatment) AS n,
  (SELECT count(*) FROM p WHERE p.card_id = o.card_id AND p.artwork = o.artwork AND p.treatment IS NOT DISTINCT FROM o.treatment) AS looks,
  (SELECT count(*) FROM p WHERE p.lineage <> o.lineage AND p.card_id = o.card_id AND p.printed_digest = o.printed_digest AND p.rarity = o.rarity AND p.treatment IS NOT DISTINCT FROM o.treatment) AS cross_n FROM o)
SELECT x.id AS observation_id,
  CASE WHEN loc IS NOT NULL THEN 'located' WHEN rev IS NOT NULL THEN 'reviewed' WHEN n = 0 AND cross_n > 0 THEN 'cross_source' WHEN n > 0 AND x.l_orderkey % 7 = 0 THEN 'inexplicit'
    WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'matched' ELSE 'allocated' END AS decision,
  CASE WHEN loc IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.id = loc AND p.card_id = x.card_id AND p.artwork = x.artwork AND p.printed_digest = x.printed_digest AND p.rarity = x.rarity AND p.treatment IS NOT DISTINCT FROM x.treatment) THEN NULL ELSE 'printing_match_contradictory' END
    WHEN rev IS NOT NULL THEN NULL WHEN n = 0 AND cross_n > 0 THEN 'printing_match_insufficient_evidence' WHEN n > 0 AND x.l_orderkey % 7 = 0 THEN 'printing_match_insufficient_evidence'
    WHEN n > 1 THEN 'printing_match_ambiguous' WHEN n = 1 THEN NULL WHEN looks > 0 THEN 'printing_match_contradictory' WHEN x.l_orderkey % 13 = 0 THEN 'printing_match_insufficient_evidence' END AS diagnostic
FROM x
""")
def q_match_printings(t: Tables) -> DataFrame:
    rows = _printings(t)
    prior = rows.where("l_orderkey % 2 = 0").withColumnRenamed("id", "printing_id")
    at = F.concat_ws("/", F.col("card_id").cast("string"), F.col("printed_digest").cast("string"))
    k = F.col("l_orderkey")
    seen = rows.where(k % 2 == 1).withColumns({"observation_id": F.col("id"), "locator": F.when(k % 5 == 0, at), "variant": F.lit("base"), "artwork_explicit": k % 7 != 0, "novel": k % 13 != 0})
    locators = prior.groupBy("lineage", at.alias("locator")).agg(F.max("printing_id").alias("printing_id")).withColumn("variant", F.lit("base"))
    reviews = seen.where(k % 11 == 0).select("observation_id", F.lit("reviewed").alias("printing_id"))
    found = reconcile.match_printings(seen, locators, prior, reviews)
    return found.select("observation_id", "decision", "diagnostic")


@named("""
WITH a AS (SELECT DISTINCT l_orderkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS id, l_orderkey % 3 AS lineage, l_partkey % 50 AS card_id,
    l_suppkey % 3 AS artwork, l_linenumber AS printed_digest, l_returnflag AS rarity, nullif(l_linestatus, 'O') AS treatment, (l_orderkey // 8) % 40 AS product FROM lineitem),
p AS (SELECT * FROM a WHERE k % 2 = 0), o AS (SELECT * FROM a WHERE k % 2 = 1),
c AS (SELECT o.id, count(p.id) AS n, min(p.id) AS first_id, count(p.id) FILTER (WHERE kept) AS n_kept, min(p.id) FILTER (WHERE kept) AS kept_id FROM o LEFT JOIN (SELECT *, true AS there FROM p) p
    ON p.card_id = o.card_id AND p.artwork = o.artwork AND p.printed_digest = o.printed_digest AND p.rarity = o.rarity AND p.treatment IS NOT DISTINCT FROM o.treatment,
    LATERAL (SELECT p.k % 16 = 0 OR p.lineage = o.lineage OR p.product = o.product AS kept) AS s GROUP BY 1),
l AS (SELECT DISTINCT card_id, artwork, treatment FROM p)
SELECT o.id AS observation_id, CASE WHEN n > 0 AND n_kept = 0 THEN first_id WHEN n > 0 THEN kept_id END AS printing_id,
  CASE WHEN n > 0 AND n_kept = 0 THEN 'uncorroborated' WHEN n_kept > 0 AND o.k % 7 = 0 THEN 'inexplicit' WHEN n_kept > 1 THEN 'ambiguous' WHEN n_kept = 1 THEN 'matched' ELSE 'allocated' END AS decision,
  CASE WHEN n > 0 AND n_kept = 0 THEN 'printing_match_insufficient_evidence' WHEN n_kept > 0 AND o.k % 7 = 0 THEN 'printing_match_insufficient_evidence' WHEN n_kept > 1 THEN 'printing_match_ambiguous' WHEN n_kept = 1 THEN NULL
    WHEN l.card_id IS NOT NULL THEN 'printing_match_contradictory' END AS diagnostic
FROM o JOIN c ON c.id = o.id LEFT JOIN l ON l.card_id = o.card_id AND l.artwork = o.artwork AND l.treatment IS NOT DISTINCT FROM o.treatment
""")
def q_corroborated_match(t: Tables) -> DataFrame:
    """Printings of another lineage match only where a product is shared."""
    rows = _printings(t).withColumns({"card_id": F.col("card_id") % 50, "artwork": F.element_at(F.split("id", "-"), 4).cast("bigint") % 3, "product": F.expr("(l_orderkey div 8) % 40")})
    prior = rows.where("l_orderkey % 2 = 0").withColumnRenamed("id", "printing_id")
    k = F.col("l_orderkey")
    asked = rows.where(k % 2 == 1).withColumns({"observation_id": F.col("id"), "locator": F.lit(None).cast("string"), "variant": F.lit("base"), "artwork_explicit": k % 7 != 0, "novel": F.lit(True)})
    seen = prior.where(k % 16 != 0).select("printing_id", "lineage")
    kept = reconcile.corroborated(asked, prior, seen, prior.select("printing_id", "product"), asked.select("observation_id", "product"))
    locators = prior.select("lineage", F.lit(None).cast("string").alias("locator"), F.lit("base").alias("variant"), "printing_id").where("locator is not null")
    found = reconcile.match_printings(asked, locators, prior, asked.select("observation_id", F.lit("x").alias("printing_id")).where("false"), kept)
    return found.select("observation_id", F.when(F.col("decision") != "allocated", F.col("printing_id")).alias("printing_id"), "decision", "diagnostic")


@named("""
WITH o AS (SELECT event_id AS observation_id, event_type AS kind, CAST(user_id % 40 AS VARCHAR) AS value FROM events),
k AS (SELECT event_type AS kind, CAST(user_id % 40 AS VARCHAR) AS value, min(event_id) AS first FROM events WHERE event_id % 2 = 0 AND user_id % 3 = 0 GROUP BY 1, 2)
SELECT observation_id, CASE WHEN observation_id % 17 = 0 THEN 'admitted' WHEN first IS NOT NULL THEN 'known-' || first
  ELSE 'card_' || sha256('g' || chr(31) || o.kind || chr(31) || o.value) END AS card_id,
  CASE WHEN observation_id % 17 = 0 THEN 'admission' WHEN first IS NOT NULL THEN 'published' ELSE 'allocated' END AS how
FROM o LEFT JOIN k ON k.kind = o.kind AND k.value = o.value
""")
def q_resolve_cards(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("observation_id"), F.lit("g").alias("game"), F.col("event_type").alias("kind"), (F.col("user_id") % 40).cast("string").alias("value"), "user_id")
    known = rows.where("observation_id % 2 = 0 and user_id % 3 = 0").groupBy("game", "kind", "value").agg(F.min("observation_id").alias("f")).select("game", "kind", "value", F.concat(F.lit("known-"), "f").alias("card_id"))
    admitted = rows.where("observation_id % 17 = 0").select("observation_id", F.lit("admitted").alias("card_id"))
    return reconcile.resolve_cards(rows.drop("user_id"), admitted, known)


@named("""
WITH o AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'C' || s_suppkey % 30 END AS code, ' Name ' || s_suppkey % 20 AS name FROM supplier),
p AS (SELECT s_suppkey + 1000 AS product_id, CASE WHEN s_suppkey % 3 = 0 THEN 'C' || s_suppkey END AS code, 'NAME ' || s_suppkey AS name FROM supplier WHERE s_acctbal >= 0),
x AS (SELECT o.key, o.code, (SELECT count(*) FROM p WHERE p.code = o.code) AS cn, (SELECT min(product_id) FROM p WHERE p.code = o.code) AS ci,
  (SELECT count(*) FROM p WHERE lower(trim(p.name)) = lower(trim(o.name)) AND (o.code IS NULL OR p.code IS NULL)) AS nn,
  (SELECT min(product_id) FROM p WHERE lower(trim(p.name)) = lower(trim(o.name)) AND (o.code IS NULL OR p.code IS NULL)) AS ni FROM o)
SELECT key, CASE WHEN cn = 1 THEN ci WHEN cn = 0 AND nn = 1 THEN ni END AS product_id, CASE WHEN cn > 1 THEN 'conflict' WHEN cn = 1 THEN 'code' WHEN nn > 1 THEN 'conflict' WHEN nn = 1 THEN 'name' ELSE 'new' END AS how FROM x
""")
def q_identify_products(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    seen = t.supplier.select(k.alias("key"), F.when(k % 2 == 0, F.concat(F.lit("C"), k % 30)).alias("code"), F.concat(F.lit(" Name "), k % 20).alias("name"))
    prior = t.supplier.where("s_acctbal >= 0").select((k + 1000).alias("product_id"), F.when(k % 3 == 0, F.concat(F.lit("C"), k)).alias("code"), F.concat(F.lit("NAME "), k).alias("name"))
    return reconcile.identify_products(seen, prior)


@named("""
WITH e AS (SELECT l_partkey, CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m-%d') END AS eff, l_orderkey * 10 + l_linenumber AS erratum_id, l_returnflag AS wording FROM lineitem),
l AS (SELECT *, coalesce(eff, '') AS d FROM e WHERE eff IS NULL OR eff <= '1998-06-30'),
m AS (SELECT l_partkey, max(d) AS d, count(*) AS n FROM l GROUP BY 1)
SELECT m.l_partkey, m.n AS n_in_force, max(l.erratum_id) AS erratum_id, max_by(l.wording, l.erratum_id) AS wording, count(DISTINCT l.wording) > 1 AS conflict
FROM m JOIN l ON l.l_partkey = m.l_partkey AND l.d = m.d GROUP BY 1, 2
""")
def q_errata_effective(t: Tables) -> DataFrame:
    errata = t.lineitem.select("l_partkey", F.when(F.col("l_linenumber") > 1, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("eff"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("erratum_id"), F.col("l_returnflag").alias("wording"))
    return reconcile.effective_errata(errata, ["l_partkey"], "1998-06-30", "eff", "erratum_id", "wording")


@named("""
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'withdrawn' ELSE 'reinstated' END AS state, event_id // 10 AS effective_at FROM events WHERE event_type IN ('error', 'signup')),
p AS (SELECT user_id, max_by(state, event_id) AS state, max_by(effective_at, event_id) AS effective_at FROM e WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY 1)
SELECT e.user_id, e.event_id, CASE WHEN p.state IS NULL THEN e.state = 'reinstated' ELSE NOT ((e.state = p.state AND e.effective_at = p.effective_at) OR (e.state <> p.state AND e.effective_at > p.effective_at)) END AS conflict
FROM e LEFT JOIN p ON p.user_id = e.user_id
""")
def q_withdrawal_transition(t: Tables) -> DataFrame:
    rows = t.events.where("event_type in ('error', 'signup')").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "withdrawn").otherwise("reinstated").alias("state"), F.expr("event_id div 10").alias("effective_at"))
    at = F.struct("state", "effective_at")
    prior = rows.where("ts < timestamp_ntz'2024-01-08 00:00:00'").groupBy("user_id").agg(F.max_by(at, "event_id").alias("p")).select("user_id", "p.*")
    return reconcile.withdrawal_conflicts(rows, prior, "user_id").select("user_id", "event_id", "conflict")


@named("""
SELECT event_type, count(*) AS n_requests, CASE WHEN NOT bool_or(event_id % 1000 = 7 AND event_type <> 'view') THEN 'collected' WHEN bool_or(event_type = 'error') THEN 'blocked' ELSE 'dropped' END AS decision
FROM events WHERE event_type <> 'click' OR event_id % 1000 <> 7 GROUP BY 1
""")
def q_source_selection(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'click' or event_id % 1000 <> 7")
    rows = rows.select("event_type", (F.col("event_id") % 1000 == 7).alias("failed"), (F.col("event_type") == "view").alias("is_image"), F.when(F.col("event_type") == "error", "required").otherwise("optional").alias("participation"))
    return reconcile.select_sources(rows, "event_type")


@named("""
WITH d AS (SELECT o_orderkey, 3 + o_orderkey % 3 AS declared FROM orders WHERE o_orderkey % 4 = 0),
l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 8 = 0 THEN l_linenumber // 2 ELSE l_linenumber END AS k FROM lineitem),
h AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT k) AS u FROM l GROUP BY 1)
SELECT o_orderkey, declared, coalesce(n, 0) AS n_leaves, coalesce(u, 0) AS n_distinct, CASE WHEN coalesce(n, 0) > coalesce(u, 0) THEN 'duplicated' WHEN coalesce(u, 0) = declared THEN 'complete' ELSE 'missing' END AS status
FROM d LEFT JOIN h ON l_orderkey = o_orderkey
""")
def q_partition_complete(t: Tables) -> DataFrame:
    declared = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", (3 + F.col("o_orderkey") % 3).alias("declared"))
    k = F.when(F.col("l_orderkey") % 8 == 0, F.expr("l_linenumber div 2")).otherwise(F.col("l_linenumber"))
    return reconcile.partition_completeness(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), k.alias("k")), declared, "o_orderkey", "k", "declared")


@named("""
WITH c AS (SELECT conv_id, turn + 1 AS page, role = 'assistant' AS last, text AS locator, conv_id % 3 + 1 AS total FROM conversations),
p AS (SELECT conv_id, count(DISTINCT page) AS n_pages, min(page) AS lo, max(page) AS hi, count(DISTINCT CASE WHEN last THEN page END) AS lasts, max(CASE WHEN last THEN page END) AS endp, count(DISTINCT locator) AS n_locators, min(total) AS a, max(total) AS b FROM c GROUP BY 1)
SELECT conv_id, n_pages, n_locators, coalesce(lo = 1 AND hi = n_pages AND lasts = 1 AND endp = hi AND a = b AND n_locators = a, false) AS closed FROM p
""")
def q_listing_closure(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", (F.col("turn") + 1).alias("page"), (F.col("role") == "assistant").alias("last"), F.col("text").alias("locator"), (F.col("conv_id") % 3 + 1).alias("total"))
    return reconcile.listing_closure(rows, "conv_id", "page", "last", "locator", "total")


@named("""
WITH w AS (SELECT doc_id, text AS warning FROM documents WHERE contains(text, '!!')),
f AS (SELECT doc_id, warning, row_number() OVER (ORDER BY doc_id) AS ordinal, sum(strlen(warning)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS b FROM w QUALIFY ordinal <= 100),
k AS (SELECT * FROM f WHERE b <= 65024)
SELECT doc_id, warning, ordinal, (SELECT count(*) FROM w) AS n_total, (SELECT max(ordinal) FROM k) < (SELECT count(*) FROM w) AS truncated FROM k
""")
def q_warning_summary(t: Tables) -> DataFrame:
    rows = t.documents.where(F.contains("text", F.lit("!!"))).select("doc_id", F.col("text").alias("warning"))
    return reconcile.warning_summary(rows, ["doc_id"], "warning")


@named("""
SELECT p_brand, p_size, count(*) AS n, p_size >= (SELECT min(s) FROM (SELECT DISTINCT q.p_size AS s FROM part q WHERE q.p_brand = part.p_brand ORDER BY 1 DESC LIMIT 3)) AS queryable FROM part GROUP BY 1, 2
""")
def q_retained_revisions(t: Tables) -> DataFrame:
    rows = t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return reconcile.retain_newest(rows, "p_brand", "p_size", 3)


@named("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def q_unreachable(t: Tables) -> DataFrame:
    return reconcile.unreachable(t.customer.select("c_custkey"), "c_custkey", t.orders.where("o_totalprice > 200000").select("o_custkey"), t.supplier.select("s_suppkey"))


@named("""
WITH d AS (SELECT doc_id, text, CAST(ceil(length(text) / 2000.0) AS BIGINT) AS n FROM documents WHERE length(text) > 2000),
c AS (SELECT doc_id, text, unnest(range(0, n)) AS ordinal FROM d)
SELECT doc_id, ordinal, sha256(substring(text, ordinal * 2000 + 1, 2000)) AS part_sha256 FROM c
""")
def q_text_parts(t: Tables) -> DataFrame:
    return reconcile.text_parts(t.documents, "doc_id", "text", 2000).select("doc_id", "ordinal", F.sha2("part", 256).alias("part_sha256"))


@named("""
SELECT event_type AS lineage, count(DISTINCT user_id) AS n_planned, count(DISTINCT CASE WHEN value > 3 THEN user_id END) AS n_sealed, count(DISTINCT user_id) = count(DISTINCT CASE WHEN value > 3 THEN user_id END) AS complete FROM events GROUP BY 1
""")
def q_coverage_status(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("lineage"), "user_id", (F.col("value") > 3).alias("sealed"))
    return reconcile.coverage_status(rows.select("lineage", "user_id"), rows, "lineage", "user_id", "sealed")


@named("""
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(props, (ts, event_id)) FILTER (WHERE value > 90) AS props FROM events GROUP BY 1
""")
def q_event_fold(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "ts", "event_id", "event_type", F.when(F.col("value") > 90, F.col("props")).alias("props"))
    return control.current(log, "user_id", ["ts", "event_id"], ["event_type", "props"])


@named("SELECT page_id, sha256(html) AS content_sha256, strlen(html) AS content_bytes FROM pages")
def q_decode_hash(t: Tables) -> DataFrame:
    """Evidence read with its digest and length verified."""
    html = F.col("html").cast("binary")
    evidence_rows = t.pages.select("page_id", html.alias("content"), F.sha2(html, 256).alias("digest"), F.octet_length("html").alias("length"))
    good = evidence.verified(evidence_rows, "content", "digest", "length")
    return good.select("page_id", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").alias("content_bytes"))


@named("""
SELECT p_partkey, p_partkey // 3 AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'admit' ELSE 'reject' END AS decision,
  CASE WHEN p_partkey % 4 = 1 THEN true WHEN p_partkey % 4 = 0 THEN p_size > 10 AND p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 ELSE false END AS permitted FROM part
""")
def q_admission(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select("p_partkey", F.expr("p_partkey div 3").alias("k"), F.when(k % 4 == 0, None).when(k % 4 == 1, "admit").otherwise("reject").alias("decision"), F.when(s > 10, "automatic").otherwise("manual").alias("policy"), (s % 2 == 0).alias("card_facts"), (k % 5 != 0).alias("printing_details"), (k % 7 != 0).alias("novel"))
    return reconcile.admission_permitted(rows).select("p_partkey", "k", "decision", "permitted")


@named("""
WITH c AS (SELECT p_partkey AS card_id, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS lineage, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN replace(p_name, ' ', '   ') WHEN 2 THEN p_name || '!' ELSE p_name END AS name FROM part),
u AS (SELECT l_partkey AS card_id, min(CASE WHEN l_linestatus = 'O' THEN 'a' ELSE 'b' END) AS lo, max(CASE WHEN l_linestatus = 'O' THEN 'a' ELSE 'b' END) AS hi FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT c.card_id, c.lineage, coalesce(trim(regexp_replace(c.name, '\\s+', ' ', 'g')) <> p_name AND lo IS NOT NULL AND NOT (lo = c.lineage AND hi = c.lineage), false) AS conflict
FROM c LEFT JOIN part p ON p.p_partkey = c.card_id AND p.p_size > 5 LEFT JOIN u ON u.card_id = c.card_id
""")
def q_published_conflict(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    shown = F.when(k % 4 == 0, F.concat(F.lit("  "), name, F.lit(" "))).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("   "))).when(k % 4 == 2, F.concat(name, F.lit("!"))).otherwise(name)
    seen = t.part.select(k.alias("card_id"), F.when(k % 3 == 0, "a").otherwise("b").alias("lineage"), F.to_json(F.struct(shown.alias("name"))).alias("facts"))
    known = t.part.where("p_size > 5").select(k.alias("card_id"), F.to_json(F.struct(name.alias("name"))).alias("facts"))
    behind = t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("card_id"), F.when(F.col("l_linestatus") == "O", "a").otherwise("b").alias("lineage"))
    return reconcile.published_conflicts(seen, known, behind).select("card_id", "lineage", "conflict")
