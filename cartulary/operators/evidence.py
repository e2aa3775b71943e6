"""Digests over ordered records, reassembly of parts, idempotent replay."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import ordered


def chained_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], line: str) -> DataFrame:
    """n_records and digest of each key: every record's digest covers the one before it; a null line makes it null.

    The chain is sequential by its definition, so a key's lines pass through one
    task, in order; only the digest before is held.
    """

    def step(s, x):
        n, d = s
        return n + 1, None if d is None or x is None else hashlib.sha256((d + x).encode()).hexdigest()

    return ordered.fold(df, keys, order, [line], lambda: (0, ""), step, lambda s: s, "n_records bigint, digest string")


def reassemble(df: DataFrame, key: str, ordinal: str, part: str) -> DataFrame:
    """n_parts, n_bytes and body_sha256 of the parts in order, joined by line feeds; null parts are only counted.

    The digest is fed part by part, so a body is never held whole.
    """

    def step(s, x):
        n, size, digest = s
        if x is None:
            return n + 1, size, digest
        body = x.encode()
        if size is not None:
            digest.update(b"\n")
        digest.update(body)
        return n + 1, (size or 0) + len(body), digest

    begin = lambda: (0, None, hashlib.sha256())
    return ordered.fold(df, [key], [ordinal], [part], begin, step, lambda s: (*s[:2], s[2].hexdigest()), "n_parts bigint, n_bytes bigint, body_sha256 string")


def replays(df: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Of each request key: n_requests, n_digests and outcome (first, replayed or conflict)."""
    each = df.groupBy(*keys, digest).agg(F.count("*").alias("n"))
    sums = each.groupBy(*keys).agg(F.sum("n").alias("n_requests"), F.count(digest).alias("n_digests"))
    return sums.withColumn("outcome", F.when(F.col("n_requests") == 1, "first").when(F.col("n_digests") == 1, "replayed").otherwise("conflict"))


def verified(snapshots: DataFrame, content: str, digest: str, length: str) -> DataFrame:
    """The snapshots; reading one whose bytes differ from its digest or length fails."""
    good = (F.sha2(content, 256) == F.col(digest)) & (F.octet_length(content) == F.col(length))
    bad = F.raise_error(F.concat(F.lit("evidence differs from its digest: "), F.col(digest)))
    return snapshots.withColumn(content, F.when(good, F.col(content)).otherwise(bad.cast("binary")))
