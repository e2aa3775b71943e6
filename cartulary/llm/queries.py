"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import contamination, language, lines, nearest, packing, quality, quotes, resampling, rules, simhash, substrings, trie, warc
from cartulary.llm.common import is_held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (F.col("__found.n_hit") > 0).alias("contaminated"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), ["doc_id"])
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), *vocabulary())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "key")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_lines(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__in_runs").alias("n_in_runs"), F.col("__alone").alias("n_alone"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# Lines with a word, numbered; a line goes if an equal one comes before it, in a run if four of them in a row do.
ORACLES["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         trim(u.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body
  FROM documents, LATERAL (
    SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) AS u
  WHERE text IS NOT NULL),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM lines WHERE body <> ''),
ranked AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY body ORDER BY doc_id, n) AS seen FROM worded),
gone AS (
  SELECT doc_id, n FROM ranked WHERE seen > 1),
windows AS (
  SELECT doc_id, n, body || chr(10) || lead(body, 1) OVER w || chr(10) || lead(body, 2) OVER w || chr(10) || lead(body, 3) OVER w AS four
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
placed AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY four ORDER BY doc_id, n) AS seen FROM windows WHERE four IS NOT NULL),
runs AS (
  SELECT DISTINCT doc_id, u.m AS n FROM placed, LATERAL (SELECT unnest(range(n, n + 4)) AS m) AS u WHERE seen > 1),
marked AS (
  SELECT l.doc_id, l.i, l.line, w.n IS NOT NULL AS has_word, g.n IS NOT NULL AS removed, r.n IS NOT NULL AS in_run
  FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.i = l.i LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.n = w.n LEFT JOIN runs r ON r.doc_id = w.doc_id AND r.n = w.n),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE in_run) AS n_in_runs,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS body
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       coalesce(k.n_in_runs, 0) AS n_in_runs, coalesce(k.n_removed - k.n_in_runs, 0) AS n_alone, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


# Windows of each item (ten words, or all of fewer) met in the documents' windows of the same lengths.
ORACLES["op3_decontamination"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS body
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) AS u WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS body
  FROM folded, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) AS u),
matches AS (SELECT d.doc_id, d.i, d.n, k.item FROM doc_windows d JOIN item_windows k ON k.n = d.n AND k.body = d.body),
hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM matches) AS m, LATERAL (SELECT unnest(range(i, i + n)) AS pos) AS u GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM matches) GROUP BY 1)
SELECT d.doc_id, coalesce(len(f.w), 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN folded f ON f.doc_id = d.doc_id LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN found x ON x.doc_id = d.doc_id
"""

# Windows of fifty words by digest, with the first document of each; words under a later one go.
ORACLES["op4_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS body FROM split, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) AS u WHERE len(w) >= 50),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, pos FROM seen, LATERAL (SELECT unnest(range(i, i + 50)) AS pos) AS u WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
kept AS (
  SELECT w.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '') AS body
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY 1)
SELECT d.doc_id, coalesce(len(s.w), 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN split s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
last AS (SELECT body, max(page_id) AS last FROM p WHERE strlen(body) >= 1000 GROUP BY 1)
SELECT page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN last ON last.body = p.body
"""


@query
def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.conversations(table(spark, sf_dir, "conversations"))))


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_nearest"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# The usual table of crc32, and the checksum of a text by it.
CRC32 = """
crc_table AS (
  SELECT list(e ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS e FROM range(256) AS r(n)))"""


def crc32(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: xor(c >> 8, t[1 + (xor(c, o) & 255)])), 4294967295)"


# Prefixes of the rebuilt conversations by the text of their turns' digests; each node adds to all that it starts with.
ORACLES["op12_prefix_trie"] = rf"""
WITH {CRC32.strip()},
turns AS (
  SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list({{'d': d, 'words': words}} ORDER BY turn NULLS FIRST, d) AS turns FROM turns GROUP BY 1),
headed AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS first, {crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 4 AS h FROM convs, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN a.h > 0 THEN coalesce(b.turns[1 : a.h], []) ELSE [] END, a.turns[a.h + 1 :]) AS turns
  FROM headed a LEFT JOIN convs b ON b.conv_id = a.first),
prefixes AS (
  SELECT conv_id, u.d AS depth, len(turns) AS length, array_to_string(list_transform(turns[1 : u.d], lambda x: x.d), '') AS path,
         CASE WHEN u.d > 0 THEN turns[u.d].words ELSE 0 END AS words
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) AS u),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '') AS ends
  FROM prefixes GROUP BY 1, 2),
kids AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
above AS (
  SELECT substr(path, 1, 32 * u.d) AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM counted, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) AS u GROUP BY 1)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN above a ON a.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = substr(c.path, 1, 32 * (c.depth - 1))
"""

ORACLES["op13_resampling"] = rf"""
WITH {CRC32.strip()},
folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
here AS (SELECT doc_id, unnest(w) AS word FROM folded),
known AS (
  SELECT word, {crc32("list_transform(range(0, strlen(word)), lambda i: CAST(('0x' || substr(hex(encode(word)), CAST(1 + 2 * i AS BIGINT), 2)) AS BIGINT))")} % 10000 AS bucket
  FROM (SELECT word FROM here UNION SELECT word FROM wanted), crc_table),
source AS (SELECT bucket, count(*) AS n FROM here JOIN known USING (word) GROUP BY 1),
target AS (SELECT bucket, count(*) AS n FROM wanted JOIN known USING (word) GROUP BY 1),
totals AS (SELECT CAST((SELECT count(*) FROM here) AS DOUBLE) AS s, CAST((SELECT count(*) FROM wanted) AS DOUBLE) AS t),
gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(y.n, 0) + 1.0::DOUBLE) * (totals.s + 10000) / ((coalesce(x.n, 0) + 1.0::DOUBLE) * (totals.t + 10000)))) AS BIGINT) AS gain
  FROM range(10000) AS b(bucket) LEFT JOIN source x ON x.bucket = b.bucket LEFT JOIN target y ON y.bucket = b.bucket, totals),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM here JOIN known USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT f.doc_id, len(f.w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(f.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM folded f LEFT JOIN weighed g ON g.doc_id = f.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
