"""Reads: pages, filters, searches, memberships, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.operators import keyset, publish, search
from cartulary.plans.registry import Tables, named

_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


@named("""
WITH probe AS (
  SELECT p_brand, p_type, p_name, p_partkey,
         strlen(p_brand) + strlen(p_type) + strlen(p_name) + 2 AS bytes
  FROM part WHERE p_size >= 5 AND (p_brand, p_type, p_name, p_partkey) > ('Brand#1', 'A', '', 0)
  ORDER BY 1, 2, 3, 4 LIMIT 41),
run AS (
  SELECT *, row_number() OVER w AS ordinal, CAST(sum(bytes) OVER w AS BIGINT) AS page_bytes FROM probe
  WINDOW w AS (ORDER BY p_brand, p_type, p_name, p_partkey ROWS UNBOUNDED PRECEDING)),
fit AS (SELECT *, ordinal <= 40 AND (ordinal = 1 OR page_bytes <= 1200) AS fits FROM run)
SELECT p_brand, p_type, p_name, p_partkey, ordinal, page_bytes, (SELECT bool_or(NOT fits) FROM fit) AS has_more
FROM fit WHERE fits
""")
def q_card_page(t: Tables) -> DataFrame:
    keys = ["p_brand", "p_type", "p_name", "p_partkey"]
    cards = t.part.where((F.col("p_size") >= 5) & keyset.after(keys, ["Brand#1", "A", "", 0])).select(*keys)
    size = F.octet_length("p_brand") + F.octet_length("p_type") + F.octet_length("p_name") + 2
    return keyset.page(cards, [F.col(k) for k in keys], size, limit=40, budget=1200)


@named("""
SELECT doc_id, source FROM documents
WHERE contains(lower(text), 'tion of') OR contains(lower(source), 'tion of')
""")
def q_card_search(t: Tables) -> DataFrame:
    return t.documents.where(search.contains_any([F.lower("text"), F.lower("source")], "tion of")).select("doc_id", "source")


@named("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'zu')")
def q_short_search(t: Tables) -> DataFrame:
    return t.documents.where(search.contains_any([F.lower("text")], "zu")).select("doc_id", "lang")


@named("""
WITH d AS (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 1200) / 400.0), 0) AS BIGINT) AS last FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS chunk FROM d)
SELECT doc_id, chunk, sha256(substring(text, chunk * 400 + 1, 1200)) AS chunk_sha256,
       length(substring(text, chunk * 400 + 1, 1200)) AS chunk_length FROM c
""")
def q_search_chunks(t: Tables) -> DataFrame:
    rows = search.chunks(t.documents.where("text is not null").select("doc_id", "text"), F.col("text"), 1200, 400)
    return rows.select("doc_id", "chunk", F.sha2("chunk_text", 256).alias("chunk_sha256"), F.char_length("chunk_text").alias("chunk_length"))


@named("""
SELECT p_partkey, p_name FROM part
WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: starts_with(x, 're'))) > 0
  AND len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: starts_with(x, 'wi'))) > 0
""")
def q_product_prefix_and(t: Tables) -> DataFrame:
    return t.part.where(search.prefix_and(F.col("p_name"), ["re", "WI"])).select("p_partkey", "p_name")


@named("""
SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
""")
def q_printings_by_product(t: Tables) -> DataFrame:
    products = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(products, "l_orderkey", "left_semi").select("l_partkey", "l_orderkey", "l_linenumber")


@named("""
SELECT DISTINCT l_partkey, r_name FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'
""")
def q_printings_by_region(t: Tables) -> DataFrame:
    # nation and region are fixed sets of the schema (25 and 5 rows).
    nations = t.nation.join(F.broadcast(t.region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = t.customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    products = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "r_name")
    return t.lineitem.select("l_orderkey", "l_partkey").join(products, "l_orderkey").select("l_partkey", "r_name").distinct()


@named("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def q_card_by_rarity(t: Tables) -> DataFrame:
    rare = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(rare, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@named("""
SELECT l_linestatus, count(*) AS n_printings FROM lineitem
WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_brand = (SELECT min(p_brand) FROM part)) GROUP BY 1
""")
def q_category_exists(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_brand").alias("p_brand"))
    cards = t.part.join(F.broadcast(first), "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(cards, "l_partkey", "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("n_printings"))


@named("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_missing_entities(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@named("""
SELECT p_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen, count(l_partkey) AS n_seen
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) l ON l_partkey = p_partkey GROUP BY p_partkey
""")
def q_left_lifecycle(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return publish.lifecycle(t.part.select("p_partkey"), seen, "p_partkey", "day")


@named("""
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS code, row_number() OVER (ORDER BY code ASC NULLS LAST, o_orderkey) AS ordinal
FROM orders WHERE o_orderstatus = 'P' ORDER BY code ASC NULLS LAST, o_orderkey LIMIT 80
""")
def q_products_null_last(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("code"))
    return keyset.page(rows, [F.asc_nulls_last("code"), F.asc("o_orderkey")], F.lit(1), limit=80).select("o_orderkey", "code", "ordinal")


@named("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) < ('1998-01-01', 100) ORDER BY 2 DESC, 1 DESC LIMIT 50
""")
def q_export_desc_keyset(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr(_DAY).alias("day"))
    return rows.where(keyset.after(["day", "o_orderkey"], ["1998-01-01", 100], descending=True)).orderBy(F.desc("day"), F.desc("o_orderkey")).limit(50)


@named("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_facts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@named("""
SELECT DISTINCT c_custkey, attribute, value FROM (
  SELECT c_custkey, unnest([{'a': 'segment', 'v': c_mktsegment}, {'a': 'name.word', 'v': split_part(c_name, '#', 1)}, {'a': 'name.word', 'v': split_part(c_name, '#', 2)}]) AS u FROM customer
) x, LATERAL (SELECT u.a AS attribute, u.v AS value) WHERE value <> ''
""")
def q_attribute_leaves(t: Tables) -> DataFrame:
    # An object's leaves become dotted paths; array members keep membership without an index.
    words = F.slice(F.split("c_name", "#"), 1, 2)
    leaves = F.concat(F.array(F.struct(F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value"))), F.transform(words, lambda w: F.struct(F.lit("name.word").alias("attribute"), w.alias("value"))))
    return t.customer.select("c_custkey", F.explode(leaves).alias("leaf")).select("c_custkey", "leaf.*").where("value <> ''").distinct()


@named("""
SELECT DISTINCT l_partkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'A'
""")
def q_membership_distinct(t: Tables) -> DataFrame:
    buyers = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    return t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey").join(buyers, "l_orderkey").select("l_partkey", "c_nationkey").distinct()


@named("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS line_ids FROM lineitem GROUP BY 1")
def q_collect_ids(t: Tables) -> DataFrame:
    # A product's lines are few by its schema, so its list is bounded.
    ids = F.sort_array(F.collect_list("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("line_ids"))


@named("SELECT p_partkey AS id, p_brand AS game, p_name AS name FROM part")
def q_public_projection(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("game"), F.col("p_name").alias("name"))


@named("SELECT p_brand AS game, count(*) AS n_cards, count(DISTINCT p_type) AS n_types, min(p_partkey) AS first_card FROM part GROUP BY 1")
def q_published_games(t: Tables) -> DataFrame:
    types = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return types.groupBy(F.col("p_brand").alias("game")).agg(F.sum("n").alias("n_cards"), F.count("*").alias("n_types"), F.min("first").alias("first_card"))


@named("SELECT s_suppkey, s_nationkey = max(s_nationkey) OVER () AS in_last_nation, count(*) OVER () AS n_total FROM supplier")
def q_partition_flag(t: Tables) -> DataFrame:
    # A window over everything is an aggregate of one row, joined back.
    whole = t.supplier.agg(F.max("s_nationkey").alias("last"), F.count("*").alias("n_total"))
    return t.supplier.crossJoin(F.broadcast(whole)).select("s_suppkey", (F.col("s_nationkey") == F.col("last")).alias("in_last_nation"), "n_total")


@named("""
SELECT source, doc_id, CAST(run AS BIGINT) AS running_bytes, CAST((run - 1) // 65536 AS BIGINT) AS page FROM (
  SELECT source, doc_id, sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents)
""")
def q_running_pages(t: Tables) -> DataFrame:
    sizes = t.documents.select("source", "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("bytes"))
    rows = keyset.prefix_sum(sizes, "source", "doc_id", F.col("bytes"), 4096, "running_bytes")
    return rows.select("source", "doc_id", "running_bytes", F.expr("(running_bytes - 1) div 65536").alias("page"))


@named("""
SELECT p_partkey, p_name, n_printings, products FROM part JOIN (
  SELECT l_partkey, CAST(sum(n) AS BIGINT) AS n_printings, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS products FROM (
    SELECT l_partkey, l_orderkey, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM lineitem GROUP BY 1, 2)
  WHERE k <= 20 GROUP BY 1) ON l_partkey = p_partkey
""")
def q_representation(t: Tables) -> DataFrame:
    """Cards with their first 20 products (a page's bound) and the printings in them."""
    each = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), "l_orderkey").agg(F.count("*").alias("n"))
    # Each task keeps its own first 20 of a card before they are dealt out.
    firsts = each.withColumn("k", F.row_number().over(W.partitionBy("p_partkey").orderBy("l_orderkey"))).where("k <= 20")
    ids = F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string"))
    pages = firsts.groupBy("p_partkey").agg(F.sum("n").alias("n_printings"), F.array_join(ids, ",").alias("products"))
    return t.part.select("p_partkey", "p_name").join(pages, "p_partkey")
