"""Indexes of a batch: in which file an id stands, and which entities a piece of text may be in.

Layout, beside a batch's entities: `indexes/<kind>/batch=<id>/ids` holds each
id's file, `…/grams` for every three code points in a row the ids of entities that
have them in a searched text (their files are then looked up by the ids): a row
holds the ids of one batch of texts, so there are far fewer rows than ids.  Both are parted by a hash (folders
`bucket=…`) and sorted within files, so a lookup reads one folder, and there the
row groups with its key.  An index is made from the written entities alone, so it
can be made again at any time; `marks` holds for each bucket the number of rows
and their hashes in one by exclusive or, by which a damaged bucket is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.operators.lineage import small_batches

if TYPE_CHECKING:
    from cartulary.catalogue.store import Files

#: Code points of a gram; shorter searches scan.
GRAM = 3
BUCKETS = {"ids": 8, "grams": 32}
#: What is written.
STORED = {"ids": "key string, file string, bucket int", "grams": "key bigint, ids array<string>, bucket int"}
#: Bytes of entities for each file of a bucket.
FILE_BYTES = 1 << 30
#: Bytes of entities for each task that writes an index.
TASK_BYTES = 4 << 20
#: Code points of a text that are looked at together.
PIECE = 1 << 18


def codes(text: str) -> np.ndarray:
    """The distinct grams of a text, each as one number: 21 bits for a code point.  A long text goes by pieces, which share GRAM - 1 code points."""
    found = []
    for at in range(0, max(1, len(text) - GRAM + 1), PIECE):
        points = np.frombuffer(text[at : at + PIECE + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found.append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _codes_of(own: Sequence[str | None] | None) -> np.ndarray:
    found = [codes(t) for t in (own if own is not None else ()) if t is not None]
    if len(found) == 1:
        return found[0]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def grams(texts: pd.Series) -> pd.Series:
    """The distinct grams of each list of texts; none of shorter and null texts, or of a null list."""
    return texts.map(_codes_of, na_action=None)


def _posted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of a batch of id, search_text every gram with the ids that have it."""
    own = [_codes_of(t.as_py()) for t in batch.column("search_text")]
    keys = np.concatenate([np.zeros(0, np.int64), *own])
    rows = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
    del own
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    del order
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), batch.column("id").cast(pa.string()).take(pa.array(rows)))
    return pa.RecordBatch.from_arrays([pa.array(keys[first]), ids], names=["key", "ids"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: _posted of each batch, of which nothing is kept while the next one is made."""
    yield from map(_posted, batches)


def gram_text(key: Column) -> Column:
    """The code points of a gram's number."""
    point = lambda n: F.lpad(F.hex(F.shiftright(key, n).bitwiseAND((1 << 21) - 1)), 8, "0")
    return F.decode(F.unhex(F.concat(point(42), point(21), point(0))), "UTF-32")


def _bucket(key: Column, part: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS[part])).cast("int")


class BatchIndex:
    """The indexes of one kind of a batch."""

    def __init__(self, spark: SparkSession, files: Files, entities: str, folder: str) -> None:
        self.spark, self.files, self.entities, self.folder = spark, files, entities, folder

    def parts(self) -> list[str]:
        return [p for p in BUCKETS if self.files.exists(f"{self.folder}/{p}")]

    def made(self, part: str) -> DataFrame:
        """The rows of a part as the entities say: key, file (of ids) or ids (of grams), bucket."""
        rows = self.spark.read.parquet(self.entities).withColumn("file", F.col("_metadata.file_name"))
        if part == "ids":
            return rows.where("id is not null").select(F.col("id").alias("key"), "file", _bucket(F.col("id"), part).alias("bucket"))
        each = rows.where("id is not null").select("id", "search_text").mapInArrow(_postings, "key bigint, ids array<string>")
        return each.withColumn("bucket", _bucket(F.col("key"), part))

    def _write(self, rows: DataFrame, part: str, mode: str) -> None:
        """Parted by bucket, and within it by a hash of the row, so that a frequent gram's rows take several tasks and files."""
        order, row = ["bucket", "key"], ["key", F.col("ids")[0]] if part == "grams" else ["key"]
        size = self.files.size(self.entities)
        salts = 1 + size // FILE_BYTES
        dealt = rows.repartition(min(BUCKETS[part] * salts, 1 + size // TASK_BYTES), "bucket", F.pmod(F.xxhash64(*row), F.lit(salts)))
        made = dealt.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#key", "true")
        with small_batches(self.spark):
            made.partitionBy("bucket").parquet(f"{self.folder}/{part}")

    def _marks(self, rows: DataFrame) -> DataFrame:
        if "ids" in rows.columns:  # each id counts, however they were put together; a row without is no row that was written
            rows = rows.select("key", F.explode_outer("ids").alias("id"), "bucket")
        columns = [c for c in ("key", "id", "file") if c in rows.columns]
        return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("digest"))

    def write(self, searched: bool) -> None:
        for part in BUCKETS if searched else ("ids",):
            self._write(self.made(part), part, "errorifexists")
            self._marks(self.stored(part)).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/marks/part={part}")

    def stored(self, part: str) -> DataFrame:
        """The rows of a part as they are written."""
        return self.spark.read.schema(STORED[part]).parquet(f"{self.folder}/{part}")

    def read(self, part: str) -> DataFrame:
        """key, file (of ids) or id (of grams), bucket: a row for each id."""
        rows = self.stored(part)
        return rows if part == "ids" else rows.select("key", F.explode("ids").alias("id"), "bucket")

    def damaged(self) -> DataFrame:
        """part, bucket, expected, found: buckets whose rows are not those that were written.  Files that can't be read count as missing."""
        out = None
        for part in BUCKETS:
            if not self.files.exists(f"{self.folder}/marks/part={part}"):
                continue
            marks = self.spark.read.parquet(f"{self.folder}/marks/part={part}")
            if self.files.exists(f"{self.folder}/{part}"):
                there = self.spark.read.schema(STORED[part]).option("ignoreCorruptFiles", "true").parquet(f"{self.folder}/{part}")
            else:
                there = self.spark.createDataFrame([], STORED[part])
            now = self._marks(there).select("bucket", F.col("n").alias("found"), F.col("digest").alias("now"))
            both = marks.join(now, "bucket", "full").where(~(F.col("n").eqNullSafe(F.col("found")) & F.col("digest").eqNullSafe(F.col("now"))))
            bad = both.select(F.lit(part).alias("part"), "bucket", F.coalesce("n", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
            out = bad if out is None else out.unionAll(bad)
        return out

    def repair(self, most: int | None = None) -> int:
        """Make damaged buckets again, `most` of them at a time; the number that is left."""
        bad = self.damaged().orderBy("part", "bucket").collect()  # bounded by the numbers of buckets
        now = bad if most is None else bad[:most]
        for part in BUCKETS:
            mine = [r for r in now if r["part"] == part]
            if mine:
                buckets = [r["bucket"] for r in mine]
                for b in buckets:  # what can't be read would stay if nothing is to be there
                    self.files.remove(f"{self.folder}/{part}/bucket={b}")
                self._write(self.made(part).where(F.col("bucket").isin(buckets)), part, "overwrite")
        return len(bad) - len(now)

    def file_of(self, entity_id: str) -> list[str]:
        """The files with the id: one folder of the index is read."""
        rows = self.read("ids").where((F.col("bucket") == _bucket(F.lit(entity_id), "ids")) & (F.col("key") == entity_id))
        return sorted(r.file for r in rows.select("file").distinct().collect())

    def files_of(self, keys: DataFrame) -> DataFrame:
        """key, file of the ids (key) that the batch has; only the folders of their buckets are read."""
        wanted = keys.withColumn("bucket", _bucket(F.col("key"), "ids"))
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # as many as there are at most
        return self.read("ids").where(F.col("bucket").isin(buckets)).join(wanted, ["key", "bucket"]).select("key", "file")

    def candidates(self, form: str) -> DataFrame:
        """The ids of the entities that have all grams of the (normalised) form, of GRAM code points or more, in any order."""
        wanted = codes(form).tolist()
        here = F.lit(False)
        for g in wanted:  # the hash of a literal is folded, so only these buckets' folders are listed
            here = here | ((F.col("bucket") == _bucket(F.lit(g), "grams")) & (F.col("key") == g))
        found = self.read("grams").where(here).groupBy("id").agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(wanted)).select("id")
