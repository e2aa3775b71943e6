"""Published revisions: immutable batches, compositions, revision-pinned reads.

Layout under a root: `entities/<kind>/batch=<id>/…` holds the rows of one
game's publication and never changes; `revisions/<sequence>.json` is one record
of the log, with the composition (each game's batch) in it.  A revision exists
once its record does, which is written last, so readers see all of it or
nothing.  Beside a batch stand its indexes (see indexes); their folders are
written before the record too.  A record's file is created only if it is not there, so of two
publishers that build upon one revision the file system lets one through; the
other one is refused, and its batch is never referred to.  (The folder has to
be in a file system that creates files exclusively, as HDFS does.)
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartulary.catalogue.indexes import GRAM, BatchIndex
from cartulary.catalogue.profiles import attribute_filter, leaves
from cartulary.functions.canon import canonical, decode_cursor, encode_cursor, search_form, search_text
from cartulary.operators import keyset, search
from cartulary.operators.lineage import small_batches, written

_LOG = "revision string, parent string, sequence bigint, published_at timestamp, game string, composition map<string, string>, schemas map<string, string>"
#: Age in milliseconds from which a record without content is that of a publisher that died.
STALE_MS = 3_600_000

#: Order of each kind's pages; nulls last.
ORDERS = {"cards": ["game", "identity_kind", "identity_value", "id"], "printings": ["card_id", "id"], "products": ["game", "official_code", "name", "id"]}
SEARCHED = {"cards": ["identity_value", "name", "rules_text"], "products": ["official_code", "name"], "printings": []}


class Conflict(Exception):
    """Another revision was published meanwhile, or blocking diagnostics are left."""


class Files:
    """The few calls to Hadoop's file system that Spark's readers and writers don't cover."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> dict[str, tuple[int, int]]:
        """Name, size and time of change of a folder's files; none if it is not there."""
        found = self.fs.listStatus(self._path(name)) if self.exists(name) else []
        return {x.getPath().getName(): (x.getLen(), x.getModificationTime()) for x in found}

    def create(self, name: str, content: str) -> bool:
        """Write a file that is not there yet; False if it is."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if self.exists(name):
                return False
            raise e
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return True

    def write(self, name: str, pieces: Iterable[bytes]) -> None:
        """A file of pieces, one after the other; what was there is replaced."""
        stream = self.fs.create(self._path(name), True)
        try:
            for p in pieces:
                stream.write(bytearray(p))
        finally:
            stream.close()

    def size(self, name: str) -> int:
        """Bytes of a folder's files."""
        return self.fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        """The content of a small file."""
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        """Delete a folder with all that it holds, if it is there."""
        self.fs.delete(self._path(name), True)


class Catalogue:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def revisions(self) -> DataFrame:
        """The log; empty before the first publication."""
        path = f"{self.root}/revisions"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).option("mode", "FAILFAST").json(path)

    def _last(self) -> dict | None:
        """The newest record that is whole: read by its name, however long the log is."""
        found = sorted((n for n, (size, _) in self.files.list(f"{self.root}/revisions").items() if n.endswith(".json") and not n.startswith(".") and size), reverse=True)
        if not found:
            return None
        try:
            return json.loads(self.files.read(f"{self.root}/revisions/{found[0]}"))
        except ValueError as e:
            raise ValueError(f"malformed record {found[0]}") from e

    def current(self) -> str | None:
        last = self._last()
        return last and last["revision"]

    def record(self, revision: str) -> dict | None:
        """A revision's record: the newest one by name, an older one out of the log."""
        last = self._last()
        if last is None or last["revision"] == revision:
            return last
        row = self.revisions().where(F.col("revision") == revision).first()
        return row and row.asDict(recursive=True)

    def composition(self, revision: str) -> dict[str, str]:
        """Game to batch: an entry for each supported game."""
        found = self.record(revision)
        return dict(found["composition"]) if found else {}

    def index(self, kind: str, batch: str) -> BatchIndex:
        return BatchIndex(self.spark, self.files, f"{self.root}/entities/{kind}/batch={batch}", f"{self.root}/indexes/{kind}/batch={batch}")

    def _next(self) -> int:
        """The number of the next record; refused while another one is being written."""
        found = {int(n.split(".")[0]): x for n, x in self.files.list(f"{self.root}/revisions").items() if n.endswith(".json") and not n.startswith(".")}
        now = time.time() * 1000
        if any(not size and now - at < STALE_MS for size, at in found.values()):
            raise Conflict("another revision is being published")
        return max(found, default=0) + 1

    def publish(self, game: str, expected: str | None, diagnostics: DataFrame | None = None, **kinds: DataFrame) -> str:
        """Publish one game's entities upon the revision expected; the other games stay as they are there."""
        if diagnostics is not None and not diagnostics.isEmpty():
            raise Conflict("the candidate has blocking diagnostics")
        # The number is taken before the look at what is current: whoever publishes in between takes it too.
        number = self._next()
        if self.current() != expected:
            raise Conflict("another revision has been published")
        revision = "revision_" + hashlib.sha256(canonical([expected, game, number]).encode()).hexdigest()[:32]
        batch = f"{game}_{number}_{uuid.uuid4().hex[:8]}"
        schemas: dict[str, str] = {}
        for kind, df in kinds.items():
            order = [c for c in ORDERS[kind] if c in df.columns]
            shaped = df.withColumn("search_text", F.array(*[search_form(F.col(c)) for c in SEARCHED[kind] if c in df.columns])) if SEARCHED[kind] else df
            # Sorted within files by the order of pages, so that a keyset reads few row groups; ids have a Bloom filter.
            ranged = shaped.sortWithinPartitions(*order).write.mode("errorifexists").option("parquet.bloom.filter.enabled#id", "true")
            with small_batches(self.spark):
                ranged.parquet(f"{self.root}/entities/{kind}/batch={batch}")
            schemas[f"{kind}/{batch}"] = shaped.schema.json()
            self.index(kind, batch).write(bool(SEARCHED[kind]))
        last = (self.record(expected) if expected else None) or {"composition": {}, "schemas": {}}
        composition = {**last["composition"], game: batch}
        kept = {k: v for k, v in (last.get("schemas") or {}).items() if k.split("/")[1] in composition.values()}
        published = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        entry = {"revision": revision, "parent": expected, "sequence": number, "published_at": published, "game": game, "composition": composition, "schemas": {**kept, **schemas}}
        if not self.files.create(f"{self.root}/revisions/{number:012d}.json", canonical(entry) + "\n"):
            raise Conflict("another revision has been published")
        return revision

    def at(self, revision: str | None = None) -> Snapshot:
        """A revision pinned for reading: the one named, else the current one."""
        found = self.record(revision) if revision else self._last()
        if not found:
            raise KeyError(f"no revision {revision}")
        return Snapshot(self, found["revision"], found["composition"], found.get("schemas") or {})


class Snapshot:
    """Reads of one revision."""

    def __init__(self, catalogue: Catalogue, revision: str, batches: Mapping[str, str], schemas: Mapping[str, str]) -> None:
        self.catalogue, self.revision, self.batches, self.schemas = catalogue, revision, dict(batches), dict(schemas)

    def _batches(self, kind: str, game: str | None) -> list[str]:
        """The batches that hold the kind: its folder is named in the record, nothing is listed."""
        batches = [b for g, b in sorted(self.batches.items()) if game in (None, g)]
        if not batches:
            raise KeyError(f"no game {game}")
        there = [b for b in batches if f"{kind}/{b}" in self.schemas]
        if not there:
            raise KeyError(f"no {kind} in {self.revision}")
        return there

    def _schema(self, kind: str, batches: Sequence[str]) -> StructType:
        """The columns of all batches, as the record has them: no footer is read for it."""
        fields: dict = {}
        for b in batches:
            for f in StructType.fromJson(json.loads(self.schemas[f"{kind}/{b}"])).fields:
                fields.setdefault(f.name, f)
        return StructType(list(fields.values()))

    def _read(self, kind: str, batches: Sequence[str], files: Sequence[str] | None = None) -> DataFrame:
        """The batches' rows; files (batch/file) restricts what is read."""
        root = f"{self.catalogue.root}/entities/{kind}"
        paths = [f"{root}/batch={b}" for b in batches] if files is None else [f"{root}/batch={x}" for x in files]
        schema = self._schema(kind, batches)
        return self.catalogue.spark.read.schema(schema).parquet(*paths) if paths else self.catalogue.spark.createDataFrame([], schema)

    def entities(self, kind: str, game: str | None = None) -> DataFrame:
        """All rows of a kind, or those of one game: only its batches' folders are read."""
        return self._read(kind, self._batches(kind, game))

    def get(self, kind: str, entity_id: str) -> dict[str, Any] | None:
        """One entity: its file by the index, there the row groups that may hold the id."""
        batches = self._batches(kind, None)
        files = [f"{b}/{f}" for b in batches for f in self.catalogue.index(kind, b).file_of(entity_id)]
        row = self._read(kind, batches, files).where(F.col("id") == entity_id).first() if files else None
        return None if row is None else row.asDict(recursive=True)

    def lookup(self, kind: str, ids: DataFrame) -> DataFrame:
        """The entities with the ids (the first column): found in the indexes, read from their files alone.

        The list of files is as long as the batches have files at most.
        """
        wanted = ids.select(F.col(ids.columns[0]).alias("key")).where("key is not null").distinct()
        batches, found = self._batches(kind, None), None
        for b in batches:
            one = self.catalogue.index(kind, b).files_of(wanted).select("key", F.concat(F.lit(f"{b}/"), "file").alias("file"))
            found = one if found is None else found.unionAll(one)
        files = [r["file"] for r in found.select("file").distinct().collect()]
        return self._read(kind, batches, sorted(files)).join(wanted.withColumnRenamed("key", "id"), "id", "left_semi")

    def known_values(self, kind: str, column: str, values: DataFrame, game: str | None = None) -> DataFrame:
        """value, known: which of the values (the first column) a filter may ask for, as the revision has them."""
        asked = values.select(F.col(values.columns[0]).alias("value")).where("value is not null").distinct()
        there = self.entities(kind, game).select(F.col(column).alias("value")).distinct().withColumn("__known", F.lit(True))
        return asked.join(there, "value", "left").select("value", F.coalesce("__known", F.lit(False)).alias("known"))

    def search(self, kind: str, q: str, game: str | None = None) -> DataFrame:
        """The entities of which a searched text has q in it, by the form that is compared.

        Of GRAM code points or more: those that have all its grams, by the
        postings, are read from their files alone, and looked through.  The list
        of files is as long as the batch has files at most.  Shorter ones scan.
        """
        form, batches = search_text(q.strip()), self._batches(kind, game)
        if not form:
            raise ValueError("an empty search")
        held = F.exists("search_text", lambda x: F.contains(x, F.lit(form)))
        if len(form) < GRAM:
            return self._read(kind, batches).where(held)
        found = None
        for b in batches:
            index = self.catalogue.index(kind, b)
            ids = written(index.candidates(form))
            one = index.files_of(ids.withColumnRenamed("id", "key")).select(F.col("key").alias("id"), F.concat(F.lit(f"{b}/"), "file").alias("file"))
            found = one if found is None else found.unionAll(one)
        found = written(found)
        files = [r["file"] for r in found.select("file").distinct().collect()]
        return self._read(kind, batches, sorted(files)).join(found.select("id").distinct(), "id", "left_semi").where(held)

    def games(self) -> list[str]:
        return sorted(self.batches)

    def find(self, kind: str, game: str | None = None, q: str | None = None, attributes: Mapping[str, str] | None = None, profile: dict | None = None, **equal: Any) -> Query:
        """A filtered collection; q is a substring of a searched field (for products, of code and name)."""
        df = self.entities(kind, game) if q is None else self.search(kind, q, game)
        for name, value in equal.items():
            df = df.where(F.col(name) == value)
        for name, value in (attributes or {}).items():
            if profile is None:
                raise ValueError("attribute filters need the game's profile")
            df = df.where(attribute_filter(profile, name, value, F.col("attributes")))
        filters = {"game": game, "q": q, "attributes": dict(attributes or {}), **{k: str(v) for k, v in equal.items()}}
        return Query(self, kind, df, filters)

    def printings_in(self, product_id: str | None = None, region: str | None = None) -> DataFrame:
        """Printings with a membership in the product, or a product released in the region."""
        products = self.entities("products")
        if product_id is not None:
            products = products.where(F.col("id") == product_id)
        if region is not None:
            products = products.where(F.array_contains("regions", region))
        ids = products.select(F.col("id").alias("product_id"))
        member = self.entities("printings").select("id", F.explode("product_ids").alias("product_id")).join(ids, "product_id", "left_semi")
        return self.entities("printings").join(member.select("id").distinct(), "id", "left_semi")

    def attribute_values(self, game: str) -> DataFrame:
        """attribute, value, n_cards of a game's cards: what filters may ask for."""
        rows = leaves(self.entities("cards", game), ["id"], "attributes")
        return rows.groupBy("attribute", "value").agg(F.count("*").alias("n_cards"))


class Query:
    """A collection at a revision, read page by page."""

    def __init__(self, snapshot: Snapshot, kind: str, df: DataFrame, filters: dict) -> None:
        self.snapshot, self.kind, self.df, self.filters = snapshot, kind, df, filters

    def page(self, limit: int = 50, after: str | None = None, budget: int = keyset.PAGE_BYTES) -> tuple[list[dict], str | None]:
        """Rows in order and the cursor of the next page, None at the end."""
        order = ORDERS[self.kind]
        bound = (self.kind, self.snapshot.revision, ",".join(order), self.filters)
        df = self.df
        if after is not None:
            df = df.where(keyset.after_nulls_last(order, decode_cursor(after, *bound)))
        size = F.octet_length(F.to_json(F.struct(*df.columns)))
        rows = keyset.page(df, [F.asc_nulls_last(c) for c in order], size, limit, budget).orderBy("ordinal").collect()
        if not rows:
            return [], None
        extra = ("ordinal", "page_bytes", "has_more", "search_text")
        cursor = encode_cursor(*bound, [rows[-1][c] for c in order]) if rows[0]["has_more"] else None
        return [{k: v for k, v in r.asDict(recursive=True).items() if k not in extra} for r in rows], cursor

    def known(self, column: str, value: Any) -> bool:
        """Whether the revision has the value at all."""
        return not self.snapshot.entities(self.kind, self.filters.get("game")).where(F.col(column) == value).limit(1).isEmpty()


def filter_condition(fields: Sequence[str], query: str) -> Column:
    """The search of the read API as a condition, for frames outside a catalogue."""
    return search.contains_any([search_form(F.col(f)) for f in fields], query)
