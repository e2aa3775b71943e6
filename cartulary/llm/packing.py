"""Packing along a space-filling curve.

Each document's tokens are hashed into a signed vector, which a fixed random
projection takes to DIMENSIONS numbers.  Standardised over the corpus and
quantised, they give the document's Hilbert key; documents are range-sorted by
(key, doc_id), which also parts a hot key, and neighbours along the curve are
packed one after the other into sequences of `length` tokens.  A document runs
over into the next sequence where one is full.  What is left at the end of a
partition is cut at powers of two, which need no padding, so no sequence is
padded at all.

Token ids come from a byte-level BPE vocabulary file; a document is its ids and
the id END.  The tokenised corpus is written once to the shared checkpoint
folder, because range partitioning reads its input twice.

Cases: a null or empty text is the id END alone.  Rows that share a doc_id are
packed one by one, in order of a hash of their ids; a null doc_id sorts first among its key.  Other columns are
left out.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, map_texts

LENGTH = 2048
END = 1
DIMENSIONS = 3
BITS = 10
HASHED = 256
CACHE_WORDS = 300_000
OUT_TOKENS = 1 << 20
#: Bytes of ids in a partition of the curve, about.
PARTITION_BYTES = 32 << 20
#: Partitions of the curve at most; beyond, they grow (a task packs its rows as they stream by).
MOST_PARTITIONS = 20_000

_SPACES = re.compile(r"\s\s|^\s|\s$")


class Tokens:
    """Ids of whole texts as little-endian 16-bit numbers.

    A text splits at single blanks between other characters, where the
    vocabulary's pattern always starts a new unit; the ids of the pieces that
    come back are remembered.  Texts with other white space next to white space
    are encoded whole.
    """

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = "<|endoftext|>"
        self.special_id = len(ranks)
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u2").tobytes()

    def _whole(self, text: str) -> bytes:
        # The vocabulary's one special token stands for its string wherever that is.
        return np.array([self.special_id], "<u2").tobytes().join(map(self._plain, text.split(self.special))) if self.special in text else self._plain(text)

    def ids(self, text: str) -> bytes:
        if not text or _SPACES.search(text) or self.special in text:
            return self._whole(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self._plain(first)]
        for w in rest:
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                got = known[w] = self._plain(" " + w)
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def _tokens(vocabulary: str, pattern: str) -> Tokens:
    return Tokens(vocabulary, pattern)


def _projection(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each 16-bit id, and the projection of the buckets."""
    rng = np.random.default_rng(seed)
    ids = np.arange(1 << 16, dtype=np.uint64)
    h = ids * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(56)).astype(np.int64) % HASHED
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    return bucket, sign, rng.normal(0, 1, (HASHED, DIMENSIONS))


def tokenise(docs: DataFrame, keep: list[str], vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns keep, ids (16-bit, END last) and at (the projected vector) of each text."""

    def work(texts):
        coder = _tokens(vocabulary, pattern)
        bucket, sign, to = _PROJECTION
        end = np.array([END], "<u2").tobytes()
        ids = [coder.ids((t or b"").decode("utf-8", "replace")) + end for t in texts]
        flat = np.frombuffer(b"".join(ids), "<u2")
        doc = np.repeat(np.arange(len(ids)), [len(x) // 2 for x in ids])
        vectors = np.zeros((len(ids), HASHED))
        for s in range(0, len(ids), 64):  # few documents at a time: the vectors are dense
            e = min(s + 64, len(ids))
            own = slice(*np.searchsorted(doc, [s, e]))
            vectors[s:e] = np.bincount((doc[own] - s) * HASHED + bucket[flat[own]], sign[flat[own]], (e - s) * HASHED).reshape(e - s, HASHED)
        vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return {"ids": ids, "at": ((vectors / np.maximum(norm, 1e-9)) @ to).tolist()}

    return map_texts(docs, work, [("ids", "binary"), ("at", "array<double>")], keep, text)


_PROJECTION = _projection()


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of points, integers below 2**bits (any dimension, by Gray-code rotation)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def with_keys(tokens: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """tokens with key, from `at` standardised by its mean and deviation over all rows; and the bytes of all ids."""
    moments = [f(F.col("at")[i]).alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = tokens.agg(*moments, F.sum(F.octet_length("ids")).alias("size")).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(DIMENSIONS)])
    deviation = np.array([row[f"s{i}"] or 1.0 for i in range(DIMENSIONS)])

    @F.pandas_udf("bigint")
    def key(at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype="int64")
        z = (np.stack(at.to_numpy()) - mean) / deviation
        # A logistic curve near the normal distribution's spreads the points over the cube evenly.
        cells = np.clip((1 << bits) / (1 + np.exp(-1.702 * z)), 0, (1 << bits) - 1).astype(np.int64)
        return pd.Series(hilbert(cells, bits))

    return tokens.withColumn("key", key("at")), row["size"] or 0


PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, key bigint"


def _pack(doc_id: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = part << 40
        room: list[tuple] = []  # the pieces of the open sequence: (doc, start, ids, doc_tokens, key)
        filled = 0
        rows: list[tuple] = []
        size = 0
        kind = None

        def close(pieces: list[tuple]) -> None:
            nonlocal number, size
            at = 0
            for doc, start, ids, total, key in pieces:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, at, key))
                at += len(ids)
            size += at
            number += 1

        def out() -> pa.RecordBatch:
            nonlocal rows, size
            cols, rows, size = list(zip(*rows, strict=True)), [], 0
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[doc_id, *[x.split()[0] for x in PIECE.split(", ")]])

        for batch in batches:
            kind = batch.column(0).type
            for doc, data, key in zip(batch.column(0).to_pylist(), batch.column("ids").to_pylist(), batch.column("key").to_pylist(), strict=True):
                ids = np.frombuffer(data, "<u2")
                at = 0
                while at < len(ids):
                    piece = ids[at : at + length - filled]
                    room.append((doc, at, piece, len(ids), key))
                    filled += len(piece)
                    at += len(piece)
                    if filled == length:
                        close(room)
                        room, filled = [], 0
                        if size >= OUT_TOKENS:
                            yield out()
        # The rest is cut at powers of two, the largest first.
        while filled:
            want = 1 << (filled.bit_length() - 1)
            taken, have = [], 0
            while have < want:
                doc, start, ids, total, key = room.pop(0)
                own = ids[: want - have]
                taken.append((doc, start, own, total, key))
                have += len(own)
                if len(own) < len(ids):
                    room.insert(0, (doc, start + len(own), ids[len(own) :], total, key))
            close(taken)
            filled -= want
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id and PIECE: the pieces of each document, with their ids as 32-bit little-endian numbers.

    vocabulary: a file of ranks (base64 of the bytes, then the id); pattern:
    the expression that splits texts into units for it.
    """
    if length & (length - 1) or not 0 < length:
        raise ValueError("length must be a power of two")
    keyed, size = with_keys(cut(tokenise(docs, [doc_id], vocabulary, pattern, text)))
    parts = min(MOST_PARTITIONS, 1 + size // PARTITION_BYTES)
    # Rows that share an id are told apart by their ids of tokens, so a task that runs again packs them as before.
    ranged = keyed.select(doc_id, "ids", "key").repartitionByRange(parts, "key", doc_id).sortWithinPartitions("key", doc_id, F.xxhash64("ids"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return ranged.mapInArrow(_pack(doc_id, length), f"{doc_id} {kind}, {PIECE}")
