"""Deterministic exports: canonical lines in byte order, bounded components, a manifest with digests."""

from __future__ import annotations

import hashlib
import json
import zlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.catalogue.store import Files
from cartulary.functions.canon import canonical, canonical_json
from cartulary.operators import ordered
from cartulary.operators.lineage import written

# Bounds of a record, a component and an export.
MOST_RECORD = 512 << 10
MOST_COMPONENT = 12 << 20
MOST_EXPORT = 24 << 20
#: Bytes of a range of keys that is ordered by one task.
PART_BYTES = 64 << 20
#: Bytes of a file that go out at once.
PIECE_BYTES = 1 << 20


def lines(records: DataFrame, kind: str, key: str) -> DataFrame:
    """kind, key, line (canonical JSON of the record) and bytes with the line feed; a record over its bound fails."""
    text = F.to_json(F.struct(F.lit(kind).alias("type"), *records.columns), {"ignoreNullFields": "false"})
    rows = records.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), canonical_json(text).alias("line"))
    rows = rows.withColumn("bytes", F.octet_length("line") + 1)
    over = F.raise_error(F.concat(F.lit("record over its bound: "), F.col("key"))).cast("string")
    return rows.withColumn("line", F.when(F.col("bytes") <= MOST_RECORD, F.col("line")).otherwise(over))


def components(rows: DataFrame, most: int = MOST_COMPONENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """lines with component: consecutive keys of a kind, each component below its bound.

    Bytes are summed by ranges of keys, and the ranges' sums, a row each, carried
    on; so no task orders more than a range, and the components don't depend on
    where the ranges end.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    dealt = rows.repartitionByRange(1 + total // part_bytes, "kind", "key")
    ranged = written(dealt.withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("kind", "__part").agg(F.sum("bytes").alias("__size"))
    before = W.partitionBy("kind").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = written(parts.select("kind", "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")))
    inner = W.partitionBy("kind", "__part").orderBy("key", "line").rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(starts, ["kind", "__part"]).withColumn("__end", F.col("__start") + F.sum("bytes").over(inner))
    return placed.select(*rows.columns, F.concat_ws("-", "kind", F.floor((F.col("__end") - 1) / most).cast("string")).alias("component"))


def manifest(rows: DataFrame) -> DataFrame:
    """component, n_records, n_bytes, sha256 of the bytes that are written; fed line by line, so a component is never held whole."""

    def step(s, line):
        n, size, digest = s
        body = line.encode() + b"\n"
        digest.update(body)
        return n + 1, size + len(body), digest

    end = lambda s: (*s[:2], s[2].hexdigest())
    return ordered.fold(rows, ["component"], ["key", "line"], ["line"], lambda: (0, 0, hashlib.sha256()), step, end, "n_records bigint, n_bytes bigint, sha256 string")


def compressed(rows: DataFrame) -> DataFrame:
    """component, piece, data: the gzip file of each component's lines, in pieces; equal lines give equal bytes.

    No time stands in the header, and codes are fixed, so the bytes depend on
    the lines alone (and on the version of zlib).
    """

    def begin():
        return zlib.compressobj(9, zlib.DEFLATED, 31, 9, zlib.Z_FIXED), bytearray(), 0

    def step(state, line):
        gzip, held, n = state
        held += gzip.compress(line.encode() + b"\n")
        if len(held) < PIECE_BYTES:
            return state, []
        return (gzip, bytearray(), n + 1), [(n, bytes(held))]

    def end(state):
        gzip, held, n = state
        return [(n, bytes(held) + gzip.flush())]

    return ordered.scan(rows, ["component"], ["key", "line"], ["line"], begin, step, end, "piece bigint, data binary")


def write(rows: DataFrame, path: str, revision: str, most: int = MOST_EXPORT) -> dict[str, Any]:
    """Write each component as a gzip file of lines, and the manifest; returns it.

    An export is within its bound, so its pieces can go through the driver, one
    at a time, into files with names and bytes of their own.
    """
    if (rows.agg(F.sum("bytes")).first()[0] or 0) > most:  # before anything is digested
        raise ValueError("the export is over its bound")
    entries = [r.asDict() for r in manifest(rows).orderBy("component").collect()]
    spark = rows.sparkSession
    files = Files(spark, path)
    pieces = written(compressed(rows))
    for e in entries:
        own = pieces.where(F.col("component") == e["component"]).orderBy("piece")
        files.write(f"{path}/components/{e['component']}.jsonl.gz", (bytes(r.data) for r in own.toLocalIterator()))
    made = {"revision": revision, "components": entries, "digest": ""}
    made["digest"] = hashlib.sha256(canonical(made).encode()).hexdigest()
    files.write(f"{path}/manifest.json", [canonical(made).encode() + b"\n"])
    return made


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the components are what the manifest says, and the manifest what its digest says."""
    made = json.loads(Files(spark, path).read(f"{path}/manifest.json"))
    own = {**made, "digest": ""}
    if hashlib.sha256(canonical(own).encode()).hexdigest() != made["digest"]:
        return False
    found = spark.read.text(f"{path}/components").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl\.gz$", 1).alias("component"), F.col("value").alias("line"))
    keyed = found.select("component", "line", F.coalesce(F.get_json_object("line", "$.id"), F.get_json_object("line", "$.key")).alias("key"), (F.octet_length("line") + 1).alias("bytes"))
    return [r.asDict() for r in manifest(keyed).orderBy("component").collect()] == made["components"]
