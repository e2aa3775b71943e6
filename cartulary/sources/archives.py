"""Immutable captures: compressed JSON lines with limits, snapshots by digest, record containers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.keyset import prefix_sum
from cartulary.operators.lineage import written

# Limits of an archive.
MOST_RECORD_BYTES = 128 << 10
MOST_RECORDS = 150_000
BLOCK_RECORDS = 1_024
BLOCK_BYTES = 4 << 20


def read_json_lines(spark: SparkSession, path: str, record_bytes: int = MOST_RECORD_BYTES) -> DataFrame:
    """path, record, bytes of every line that isn't empty (gzip by its suffix); a record over the limit fails.

    A compressed file is one task's work; what follows is dealt out anew.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("record"), F.octet_length("value").cast("bigint").alias("bytes")).where("bytes > 0")
    over = F.raise_error(F.concat(F.lit("record over the limit in "), F.col("path"))).cast("string")
    return lines.withColumn("record", F.when(F.col("bytes") <= record_bytes, F.col("record")).otherwise(over)).hint("rebalance")


def within_archive_limits(records: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """path, n_records, n_bytes and whether the archive keeps to the limit."""
    return records.groupBy("path").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("n_bytes")).withColumn("within_limit", F.col("n_records") <= most)


def blocks(records: DataFrame, group: str, ordinal: str, size: Column, most_records: int = BLOCK_RECORDS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records with block, by ordinals from 0 and running bytes: most_records at most in one, and its first bytes below a multiple of most_bytes."""
    rows = prefix_sum(records, group, ordinal, size, 1 << 16, "running_bytes")
    return rows.withColumn("block", F.struct(F.floor(F.col(ordinal) / most_records).alias("by_count"), F.floor((F.col("running_bytes") - 1) / most_bytes).alias("by_bytes")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256, bytes of every file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def container_records(pages: DataFrame, json: str, path: str, keep: Sequence[str]) -> DataFrame:
    """keep, ordinal, record: the members of the array at a JSON path of each page; pages without it give no row."""
    members = F.from_json(F.get_json_object(json, path), "array<string>")
    return pages.select(*keep, F.posexplode(members).alias("ordinal", "record"))


def object_members(pages: DataFrame, json: str, keep: Sequence[str]) -> DataFrame:
    """keep, key, value (as JSON) of each member of the object that each page is."""
    return pages.select(*keep, F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))


def per_finish(records: DataFrame, record: str, keep: Sequence[str], excluded_layouts: Sequence[str] = ("art_series", "token")) -> DataFrame:
    """An observation for each finish of a card record; excluded and unresolved records give one row that says so.

    outcome: observed, excluded (a layout that is left out) or review (no finish).
    """
    layout = F.get_json_object(record, "$.layout")
    finishes = F.from_json(F.get_json_object(record, "$.finishes"), "array<string>")
    rows = records.select(*keep, F.get_json_object(record, "$.id").alias("source_id"), F.get_json_object(record, "$.name").alias("name"), layout.alias("layout"), finishes.alias("finishes"))
    out = F.coalesce(F.col("layout").isin(*excluded_layouts), F.lit(False))
    none = F.coalesce(F.size("finishes"), F.lit(0)) < 1
    finish = F.explode_outer(F.when(~out, F.array_distinct("finishes")))
    outcome = F.when(out, "excluded").when(none, "review").otherwise("observed")
    return rows.select(*keep, "source_id", "name", "layout", outcome.alias("outcome"), finish.alias("finish"))


def changed_only(captures: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """The captures whose bytes are not known yet."""
    return captures.join(known.select(digest).distinct(), digest, "left_anti")


# Request headers that a request's fingerprint binds, and those that are sent without being named.
REPRESENTED_HEADERS = ("accept", "accept-language", "user-agent")
IMPLICIT_HEADERS = ("accept-encoding",)


def reusable(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """request_id, snapshot_id: the last retained image that may stand for each request, so that it needs no call.

    requests: request_id, role, lineage, url, adapter, fingerprint, headers (a
    map).  snapshots: snapshot_id, lineage, url, adapter, fingerprint, headers of
    its request, vary (the names that its response varied on), captured_at.  All
    of a snapshot's keys must be the request's.  Each name of vary must be one
    that the fingerprint binds, or be absent from both requests and none that is
    sent unnamed; `*` and an unknown (null) vary never fit.
    """
    keys = ["lineage", "url", "adapter", "fingerprint"]
    names = lambda c: F.transform(F.map_keys(F.coalesce(c, F.create_map().cast("map<string,string>"))), F.lower)
    free = F.filter(F.transform("vary", F.lower), lambda n: ~n.isin(*REPRESENTED_HEADERS))
    kept = snapshots.withColumn("__free", free).where("vary is not null").where(~F.exists("__free", lambda n: n.isin("*", *IMPLICIT_HEADERS)))
    kept = kept.where(~F.arrays_overlap("__free", names(F.col("headers"))))
    # What is left of a snapshot is which names a request must not send: the last one of each such set is enough.
    last = kept.groupBy(*keys, F.array_sort(F.array_distinct("__free")).alias("__free")).agg(F.max(F.struct("captured_at", "snapshot_id")).alias("__s"))
    asked = requests.where("role = 'image'").select("request_id", *keys, names(F.col("headers")).alias("__sent"))
    fits = asked.join(written(last), keys).where(~F.arrays_overlap("__sent", "__free"))
    return fits.groupBy("request_id").agg(F.max("__s").alias("s")).select("request_id", F.col("s.snapshot_id").alias("snapshot_id"))


def container_fault(json: Column, most_bytes: int, most_depth: int, most_tokens: int) -> Column:
    """Why a page's JSON is not read: too_long (bytes), too_deep (levels of objects and arrays), too_many_tokens (brackets, commas, colons); null if it may be.

    Told from the text alone, before anything is parsed: strings are taken out,
    then the innermost pairs of brackets, once for each level.
    """
    bare = F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', "")
    tokens = F.length(F.regexp_replace(bare, r"[^\[\]{},:]", ""))
    nested = F.regexp_replace(bare, r"[^\[\]{}]", "")
    for _ in range(most_depth):
        nested = F.regexp_replace(nested, r"\[\]|\{\}", "")
    return F.when(F.octet_length(json) > most_bytes, "too_long").when(tokens > most_tokens, "too_many_tokens").when(F.length(nested) > 0, "too_deep")
