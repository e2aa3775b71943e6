"""Importance resampling towards a target distribution of hashed n-grams.

Features are runs of 1 to `longest` consecutive words, each dealt to one of
`buckets` buckets.  Tasks count their own buckets, so one row for each task and
bucket is all that is shuffled; the ratio of the target's share of a bucket to
the source's gives an array of gains, of fixed size whatever the input.  A
document's weight is the sum over its features, looked up in that array.  A
noise that its id alone decides turns the largest scores into a draw without
replacement in proportion to the weights' exponentials.

The draw sorts in two steps.  Eligible rows are parted by score into ranges, of
which each task sorts runs of a bounded size that go to the shared folder.  A
tournament tree merges a range's runs, opening each block of a run when the
merge comes to it; counts of the ranges before it give the ranks, and it stops
after the exact number to draw.  Ranges that begin behind that number are never
merged.

Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII characters.
Cases: null, empty and wordless texts have no feature and weigh 0.  Documents
are judged row by row, so repeated rows are drawn one by one; a null id makes
its noise with an empty text and comes last among ties.  A source or target
without words has equal shares.  An empty table gives an empty one.  Columns
other than id and text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartulary.llm.common import cut, long_id, map_texts, slices, stored
from cartulary.llm.contamination import words_of
from cartulary.llm.merging import LoserTree, Merge

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Rows of a range and of a run (40 bytes each), and of a block that the merge opens at once.
RANGE_ROWS = 2_000_000
MOST_RANGES = 10_000
RUN_ROWS = 200_000
BLOCK_ROWS = 4_096
#: Features that a worker remembers the buckets of.
REMEMBERED = 500_000


class _Buckets(dict):
    """value(bucket) of each feature, remembered."""

    def __init__(self, buckets: int, value=int) -> None:
        self.buckets, self.value = buckets, value

    def __missing__(self, feature: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = out = self.value(zlib.crc32(feature) % self.buckets)
        return out


def features(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to longest words, joined by a space."""
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts by bucket; a dictionary of at most `buckets` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bucket = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for part in slices(batch, "__text"):
                for t in part.column(0).to_pylist():
                    found = features(words_of(t), longest)
                    counts += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(run, "bucket bigint, n bigint")
    return {r.bucket: r.n for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def noise(seed: int, doc_id: int | None) -> int:
    """A Gumbel variate of the id, in thousandths, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""
    values = np.array(gain, np.int64)

    def work(texts, ids):
        weigh = work.__dict__.setdefault("weigh", _Buckets(len(values), values.tolist().__getitem__))
        out = {"n_words": [], "n_features": [], "weight": [], "score": []}
        for t, own in zip(texts, ids, strict=True):
            words = words_of(t)
            found = features(words, longest)
            weight = sum(map(weigh.__getitem__, found))
            out["n_words"].append(len(words))
            out["n_features"].append(len(found))
            out["weight"].append(weight)
            out["score"].append(weight + noise(seed, own))
        return out

    rows = docs.select(long_id(docs, doc_id), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, work, [(n, "bigint") for n in ("n_words", "n_features", "weight", "score")], ["doc_id"], also="doc_id")


_ROW = ["doc_id", "n_features", "weight", "score"]
_RUNS = "range int, run bigint, first_score bigint, first_id bigint, n bigint, doc_id array<bigint>, n_features array<bigint>, weight array<bigint>, score array<bigint>"


def _order(row: tuple) -> tuple:
    return -row[3], row[0] is None, row[0] or 0


def sorted_runs(eligible: DataFrame, ranges: int) -> DataFrame:
    """Rows by score ranges, each task's in sorted runs, each run in blocks: see _RUNS; first_score counts downwards."""

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(_RUNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, rows = TaskContext.get().partitionId(), 0, []

        def blocks() -> pa.RecordBatch:
            rows.sort(key=_order)
            parts = [rows[i : i + BLOCK_ROWS] for i in range(0, len(rows), BLOCK_ROWS)]
            made = [[at] * len(parts), [number] * len(parts), [-p[0][3] for p in parts], [p[0][0] for p in parts], [len(p) for p in parts]]
            made += [[[r[c] for r in p] for p in parts] for c in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(rows) >= RUN_ROWS:
                yield blocks()
                number, rows = number + 1, []
        if rows:
            yield blocks()

    dealt = eligible.select(*_ROW).repartitionByRange(ranges, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return dealt.mapInArrow(run, _RUNS)


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks in order of range and first row, all rows; those before `draw` with their rank."""

    def blocks() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield row.column("range")[0].as_py(), row.column("before")[0].as_py(), row.column("draw")[0].as_py(), list(zip(*(row.column(c)[0].as_py() for c in _ROW), strict=True))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=[*_ROW, "rank"])

    coming, waiting = blocks(), None

    def of_range(number: int) -> Iterator[tuple]:
        """The blocks of a range; the first one after it waits."""
        nonlocal waiting
        while waiting is not None and waiting[0] == number:
            rows = waiting[3]
            yield _order(rows[0]), iter(rows)
            waiting = next(coming, None)

    waiting = next(coming, None)
    out: list[tuple] = []
    while waiting is not None:
        number, before, draw = waiting[:3]
        merge = Merge(LoserTree(_order), of_range(number))
        drawn = ((*row, place) for place, row in zip(range(before + 1, draw + 1), merge))  # noqa: B905
        # Behind the draw nothing is merged: the rest of the range goes out as it stands.
        for row in chain(drawn, ((*row, None) for row in merge.left())):
            out.append(row)
            if len(out) == BLOCK_ROWS:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank counts the drawn rows, percent of those with least_words words; null for the rest."""
    scored, _ = stored(scored)
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    most = percent * n // 100
    runs, _ = stored(sorted_runs(scored.where(able), min(MOST_RANGES, 1 + n // RANGE_ROWS)))
    # A row for each range: how many come before it.
    sizes = cut(runs.groupBy("range").agg(F.sum("n").alias("size")))
    before = sizes.select(F.col("range"), (F.sum("size").over(W.orderBy("range")) - F.col("size")).alias("before"))
    runs = runs.join(before, "range").withColumn("draw", F.lit(most))
    parts = max(1, sizes.count())
    merged = runs.where(F.col("before") < most).repartition(parts, "range").sortWithinPartitions("range", "first_score", F.col("first_id").asc_nulls_last())
    merged = merged.select("range", "before", "draw", *_ROW).mapInArrow(_merge_ranges, ", ".join(f"{c} bigint" for c in [*_ROW, "rank"]))
    behind = runs.where(F.col("before") >= most).select(F.explode(F.arrays_zip(*_ROW)).alias("r")).select("r.*", F.lit(None).cast("bigint").alias("rank"))
    short = scored.where(~able).select(*_ROW, F.lit(None).cast("bigint").alias("rank"))
    return merged.unionAll(behind).unionAll(short)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    return draw(scores(docs, gain, doc_id, text, longest, seed), percent, least_words)
