"""Line deduplication by winnowing over line hashes, then line by line.

Texts split at line feeds; lines without a word are skipped.  Of each window of
`window` consecutive lines the one with the smallest hash (the rightmost of
equals) is selected, so two texts that share `window` lines in a row select the
same one of them: its hash is a guaranteed fingerprint.  Only selected lines are
dealt out (about 2 in `window` + 1), each with the hashes of the windows that it
stands for, which reach from before it to after it.  Lines whose fingerprint is
selected in two places or more are joined, and the matches extended both ways,
a line at a time, through those windows, compared by 128 bits.  A line goes if a
window over it also starts earlier, in a document with a smaller doc_id or before
it in the same document.  So of each repeated run of `window` lines or more the
first one stays and the later ones are deleted.

Runs shorter than the window have no guaranteed fingerprint.  With `alone` an
exact second step takes the lines that are left: each that equals an earlier one,
by 128 bits, goes too.  (The first place of a line is never deleted, so the lines
left are enough to tell.)

Lines are compared with white space at both ends stripped.  Cases: a null text
has no lines; texts of fewer lines than the window lose nothing in the first
step.  Rows that share doc_id and text are one document for the comparison, and
each comes back; rows that share a doc_id only count as earlier or later by a
hash of the text.  A row with a null doc_id neither takes lines from others nor
loses any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm import rolling
from cartulary.llm.common import cut, discard, explode_texts, stored

#: Lines of a window: repeated runs of so many are found by winnowing.
WINDOW = 4
_BLANK = b" \t\r\x0b\x0c"


def split_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those with a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_BLANK)]


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of the sequence, the position of its smallest hash, the rightmost of equals."""
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.arange(len(views)) + window - 1 - views.argmin(axis=1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, h0, h1: two hashes of each line with a word; texts of none are left out."""

    def work(texts, ids):
        found = [[lines[k].strip(_BLANK) for k in at] for lines, at in map(split_lines, texts)]
        sizes = np.array([len(f) for f in found], np.int64)
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for f in found for x in f), np.int64).reshape(-1, 2)
        kept = np.flatnonzero(sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]), pa.int32())
        lists = {n: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(both[:, i]))) for i, n in enumerate(("h0", "h1"))}
        return {"doc_id": ids[0].take(pa.array(kept)), "tkey": ids[1].take(pa.array(kept)), **lists}

    return explode_texts(docs, work, "doc_id bigint, tkey bigint, h0 array<bigint>, h1 array<bigint>", ["doc_id", "tkey"])


def _documents(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray | None, ...]]:
    """The lists of each row as arrays, None for a null."""
    parts = []
    for c in columns:
        col = batch.column(c)
        parts.append((col.is_valid().to_numpy(zero_copy_only=False), col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)))
    for i in range(batch.num_rows):
        yield tuple(values[ends[i] : ends[i + 1]] if valid[i] else None for valid, ends, values in parts)


def selections(hashed: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, mark, start, w0, w1: each selected line's hash, the first window that it stands for, and 128 bits of each of these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, mark, start, sizes, w0, w1 = ([np.zeros(0, np.int64)] for _ in range(6))
            for i, (first, second) in enumerate(_documents(batch, "h0", "h1")):
                if len(first) < window:
                    continue
                a, b = first.view(np.uint64), second.view(np.uint64)
                chosen = selected(a, window)  # of each window; those of one line follow each other
                begins = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                starts = np.arange(len(chosen))
                owner.append(np.full(len(begins), i))
                mark.append(first[chosen[begins]])
                start.append(begins)
                sizes.append(np.diff(np.append(begins, len(chosen))))
                w0.append(rolling.Windows(a, 0).at(starts, window).view(np.int64))
                w1.append(rolling.Windows(b, 1).at(starts, window).view(np.int64))
            owner = pa.array(np.concatenate(owner))
            ends = pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
            cols = [batch.column("doc_id").take(owner), batch.column("tkey").take(owner), pa.array(np.concatenate(mark)), pa.array(np.concatenate(start))]
            cols += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (w0, w1)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tkey", "mark", "start", "w0", "w1"])

    return hashed.select("doc_id", "tkey", "h0", "h1").mapInArrow(run, "doc_id bigint, tkey bigint, mark bigint, start bigint, w0 array<bigint>, w1 array<bigint>")


def later_windows(hashed: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, starts: the windows that also start earlier; starts count lines with a word."""
    found = cut(selections(hashed, window))
    here = F.xxhash64("doc_id", "tkey", "start")
    marks = found.groupBy("mark").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo < hi").select("mark")
    # Written apart, so that the joins' sides are plain shuffles, of which Spark can split a hot key's.
    marks = cut(marks)
    shared = found.join(marks, "mark").select("doc_id", "tkey", "start", F.posexplode(F.arrays_zip("w0", "w1")))
    shared = cut(shared.select("doc_id", "tkey", (F.col("start") + F.col("pos")).alias("start"), "col.w0", "col.w1"))
    place = F.struct("doc_id", "tkey", "start")
    first = cut(shared.groupBy("w0", "w1").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").drop("hi"))
    later = shared.join(first, ["w0", "w1"]).where(place > F.col("lo"))
    return later.groupBy("doc_id", "tkey").agg(F.collect_set("start").alias("starts"))


def lines_left(hashed: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, n, h0, h1: the lines under no window of runs (doc_id, tkey, starts), by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, h0, h1 = ([np.zeros(0, np.int64)] for _ in range(4))
            for i, (first, second, starts) in enumerate(_documents(batch, "h0", "h1", "starts")):
                at = np.arange(len(first)) if starts is None else np.flatnonzero(~rolling.covered(starts, window, len(first)))
                owner.append(np.full(len(at), i))
                number.append(at)
                h0.append(first[at])
                h1.append(second[at])
            owner = pa.array(np.concatenate(owner))
            cols = [batch.column("doc_id").take(owner), batch.column("tkey").take(owner), *(pa.array(np.concatenate(x)) for x in (number, h0, h1))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tkey", "n", "h0", "h1"])

    joined = hashed.join(runs, ["doc_id", "tkey"], "left").select("doc_id", "tkey", "h0", "h1", "starts")
    return joined.mapInArrow(run, "doc_id bigint, tkey bigint, n bigint, h0 bigint, h1 bigint")


def later_lines(left: DataFrame) -> DataFrame:
    """doc_id, tkey, singles: the numbers of the lines that equal an earlier one of those left."""
    left = cut(left)
    place = F.struct("doc_id", "tkey", "n")
    first = cut(left.groupBy("h0", "h1").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").drop("hi"))
    later = left.join(first, ["h0", "h1"]).where(place > F.col("lo"))
    return later.groupBy("doc_id", "tkey").agg(F.collect_set("n").alias("singles"))


def remove_lines(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, alone: bool = True) -> DataFrame:
    """The columns keep (all by default; the text shortened) and, for each row, __lines (lines with a word), __removed, and of these __in_runs (by winnowing) and __alone (by the second step)."""
    keep = keep or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c != text]).alias("kept"), F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tkey"), F.col(f"`{text}`").alias("text"))
    hashed, path = stored(line_hashes(rows.where("doc_id is not null and text is not null").select("doc_id", "tkey", "text")))
    found = cut(later_windows(hashed, window))
    if alone:
        singles = later_lines(lines_left(hashed, found, window))
        found = cut(found.join(singles, ["doc_id", "tkey"], "full"))
    else:
        found = found.withColumn("singles", F.lit(None).cast("array<bigint>"))
    discard(docs.sparkSession, path)
    counts = ("__lines", "__removed", "__in_runs", "__alone")
    schema = T.StructType([rows.schema["kept"], T.StructField("body", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in counts)])

    def work(texts, ids):
        out = {"body": [], **{c: [] for c in counts}}
        for t, starts, singles in zip(texts, ids[1].to_pylist(), ids[2].to_pylist(), strict=True):
            lines, at = split_lines(t) if t is not None else ([], [])
            in_runs = int(rolling.covered(np.array(starts, np.int64), window, len(at)).sum()) if starts else 0
            if starts or singles:
                gone = rolling.covered(np.array(starts or [], np.int64), window, len(at))
                gone[singles or []] = True
                dropped = set(np.array(at)[gone].tolist())
                t = b"\n".join(x for i, x in enumerate(lines) if i not in dropped)
            alone = len(singles or [])
            out["body"].append(t)
            for c, n in zip(counts, (len(at), in_runs + alone, in_runs, alone), strict=True):
                out[c].append(n)
        return {"kept": ids[0], "body": pa.array(out.pop("body"), pa.binary()), **out}

    got = explode_texts(rows.join(found, ["doc_id", "tkey"], "left"), work, schema, ["kept", "starts", "singles"])
    return got.select(*[F.col("body").cast("string").alias(text) if c == text else F.col("kept").getField(c).alias(c) for c in keep], *counts)
