"""WARC archives in seekable Zstandard bundles.

Consecutive records make an independent Zstandard frame of about FRAME_BYTES
(before compression), frames make a bundle of up to BUNDLE_BYTES.  A skippable frame at
a bundle's end is the seek table (compressed and plain size of each frame, after
the seekable format's layout: frame count, descriptor and magic number last).
Before it another skippable frame, itself compressed, maps the records'
identifiers to frame number and offset in the frame.  One record is read by
ranges: the footer, the index and one frame; the rest of the bundle is not
touched.

Tasks stream bundles into the folder, whichever file system it is in, under
names of their own for each attempt.  A table beside them, which Spark commits,
lists the bundles that count, so nothing of a lost attempt is ever read.

Payloads are the UTF-8 bytes of the html.  Of records with equal payloads of at
least LEAST_REVISIT bytes, the one with the largest page_id is a response and
the others revisit it (headers only; length and digest of the full payload stay
in the headers).  Cases: a null html is an empty payload; smaller payloads are
all responses; rows that share page_id and payload are all responses; a null
page_id is stored as an empty identifier with a flag in the index, is a response
and is no one's original; a null url is left out of the record.  A record is
never parted: one beyond FRAME_BYTES is a frame of its own.  Other columns are
left out.
"""

from __future__ import annotations

import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import cut, discard, ensure_checkpoint_dir

LEAST_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 512 << 20
LEVEL = 3
#: Bytes from a bundle's end that are read first; they mostly hold the seek table.
TAIL_BYTES = 16 << 10
#: Bytes of payload in a batch of read records, about.
OUT_BYTES = 4 << 20

# Fixed values of the Zstandard seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1

#: An index entry: whether there is no identifier, the identifier, frame, offset in the frame.
_ENTRY = struct.Struct("<?qII")
_SIZES = struct.Struct("<II")
_FOOTER = struct.Struct("<IBI")

RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, frame bigint, offset bigint, payload binary"
_MANIFEST = "bundle string, records bigint, frames bigint, bytes bigint"
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload block."""
    kind = "response" if refers_to is None else "revisit"
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = payload if refers_to is None else b""
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    to = fields.get("WARC-Refers-To")
    return {
        "page_id": int(name) if name else None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": int(to[len("<urn:page:") : -1]) if to else None, "target_uri": fields.get("WARC-Target-URI"),
        "payload": None if to else rest[: int(fields["Content-Length"])],
    }


class Writer:
    """A bundle that goes to a stream frame by frame; only its index is held."""

    def __init__(self, to: BinaryIO, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.to, self.frame_bytes = to, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.size = self.bytes = self.records = 0
        self.index = bytearray()
        self.sizes: list[tuple[int, int]] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.held and self.size + len(data) > self.frame_bytes:
            self._close_frame()
        self.index += _ENTRY.pack(page_id is None, page_id or 0, len(self.sizes), self.size)
        self.held.append(data)
        self.size += len(data)
        self.records += 1

    def _put(self, data: bytes, plain: int | None = None) -> None:
        self.to.write(data)
        self.bytes += len(data)
        if plain is not None:
            self.sizes.append((len(data), plain))

    def _close_frame(self) -> None:
        self._put(self.packer.compress(b"".join(self.held)), self.size)
        self.held, self.size = [], 0

    def finish(self) -> None:
        if self.held:
            self._close_frame()
        packed = self.packer.compress(bytes(self.index))
        self._put(_SIZES.pack(SKIPPABLE_INDEX, len(packed)) + packed, 0)
        table = b"".join(_SIZES.pack(*s) for s in self.sizes) + _FOOTER.pack(len(self.sizes), 0, SEEKABLE_MAGIC)
        self._put(_SIZES.pack(SKIPPABLE_TABLE, len(table)) + table)


class Bundle:
    """Random access by ranges to a bundle in an open file; bytes_read counts what was read."""

    def __init__(self, file: pa.NativeFile | BinaryIO) -> None:
        self.file, self.bytes_read = file, 0
        self.end = file.seek(0, 2)
        tail = self._range(max(0, self.end - TAIL_BYTES), self.end)
        n, descriptor, magic = _FOOTER.unpack(tail[-_FOOTER.size :])
        if magic != SEEKABLE_MAGIC or descriptor:
            raise ValueError("no seek table at the end")
        table = _SIZES.size * n + _FOOTER.size
        if table > len(tail):
            tail = self._range(self.end - table, self.end)
        #: Where each frame begins, and the end of the last one, which is the index.
        self.starts = [0]
        for packed, _ in _SIZES.iter_unpack(tail[-table : -_FOOTER.size]):
            self.starts.append(self.starts[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(self._range(self.starts[n - 1] + _SIZES.size, self.starts[n]))
        #: (page_id, frame, offset) of each record, in the order in which they stand.
        self.entries = [(None if missing else i, frame, offset) for missing, i, frame, offset in _ENTRY.iter_unpack(index)]

    def _range(self, begin: int, end: int) -> bytes:
        self.file.seek(begin)
        data = self.file.read(end - begin)
        self.bytes_read += len(data)
        return bytes(data)

    def frame(self, number: int) -> bytes:
        return self.unpack.decompress(self._range(self.starts[number], self.starts[number + 1]))

    def records(self, wanted: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(frame, offset, record) of the wanted (frame, offset), of all by default; a frame is read once."""
        offsets = defaultdict(list)
        for _, frame, offset in self.entries:
            offsets[frame].append(offset)
        chosen = defaultdict(set)
        for frame, offset in wanted or ():
            chosen[frame].add(offset)
        for frame in sorted(offsets if wanted is None else chosen):
            data, begins = self.frame(frame), offsets[frame]
            for begin, end in zip(begins, [*begins[1:], len(data)], strict=True):
                if wanted is None or begin in chosen[frame]:
                    yield frame, begin, data[begin:end]

    def get(self, page_id: int) -> list[bytes]:
        return [x for _, _, x in self.records([(f, o) for i, f, o in self.entries if i == page_id])]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest, refers_to of the records that revisit another; pages: page_id, digest, size."""
    large = pages.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lo")).where("lo < refers_to").drop("lo")
    # Written apart, so that the join's sides are plain shuffles, of which Spark can split a hot payload's.
    return large.join(cut(first), ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write the records of pages into bundles under path, which must not exist."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    again = revisits(rows.select("page_id", "digest", "size"), least)
    joined = rows.join(again, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        system.create_dir(f"{folder}/bundles", recursive=True)
        now: Writer | None = None
        name = ""

        def done() -> pa.RecordBatch:
            now.finish()
            now.to.close()
            cols = [[name], [now.records], [len(now.sizes) - 1], [now.bytes]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in _MANIFEST.split(", ")])

        for batch in batches:
            for r in zip(*(batch.column(n) for n in ("page_id", "url", "payload", "size", "digest", "refers_to")), strict=True):
                if now is None:
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    now = Writer(system.open_output_stream(f"{folder}/{name}", compression=None), frame_bytes)
                values = [x.as_py() for x in r]
                now.add(values[0], record(*values))
                if now.bytes >= bundle_bytes:
                    yield done()
                    now = None
        if now is not None:
            yield done()

    joined.mapInArrow(run, _MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """bundle (relative to path), records, frames, bytes of each bundle that counts."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _dealt(bundles: DataFrame) -> DataFrame:
    """A bundle or so to a partition: the table of them is small and would be one."""
    return bundles.repartition(max(1, bundles.count()))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.strip().split(" ") for x in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _over_bundles(path: str, work, schema: str):
    """For mapInArrow: the rows that work makes of each bundle (and the row's other values), in batches of about OUT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for batch in batches:
            for name, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{folder}/{name}") as file:
                    rows, size = [], 0
                    for row, weight in work(Bundle(file), name, *more):
                        rows.append(row)
                        size += weight
                        if size >= OUT_BYTES:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                    yield _batch(rows, schema)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path (RECORD); payload is null for revisits, frame and offset are its place in the bundle."""
    order = [x.strip().split(" ")[0] for x in RECORD.split(",")]

    def work(bundle: Bundle, name: str):
        for frame, offset, data in bundle.records():
            found = {**parse(data), "frame": frame, "offset": offset}
            yield tuple(found[n] for n in order), len(data) + 200

    return _dealt(manifest(spark, path).select("bundle")).mapInArrow(_over_bundles(path, work, RECORD), RECORD)


_PLACE = "bundle string, page_id bigint, frame bigint, offset bigint"


def locate(spark: SparkSession, path: str) -> DataFrame:
    """bundle, page_id, frame, offset (in the frame) of every record, read from the bundles' ends alone."""

    def work(bundle: Bundle, name: str):
        for page_id, frame, offset in bundle.entries:
            yield (name, page_id, frame, offset), 64

    return _dealt(manifest(spark, path).select("bundle")).mapInArrow(_over_bundles(path, work, _PLACE), _PLACE)


_FETCHED = "page_id bigint, record binary, bundle_bytes_read bigint"


def fetch(spark: SparkSession, path: str, page_ids: DataFrame) -> DataFrame:
    """The records of the given page_ids (a column page_id), by their index entries and frames; bundle_bytes_read is what that took of the bundle."""
    places = locate(spark, path).join(page_ids.select("page_id").distinct(), "page_id")
    wanted = places.groupBy("bundle").agg(F.collect_set(F.struct("frame", "offset")).alias("places"))  # no more than a bundle's records

    def work(bundle: Bundle, name: str, places: list[dict]):
        found = list(bundle.records([(p["frame"], p["offset"]) for p in places]))
        for _, _, data in found:
            yield (parse(data)["page_id"], data, bundle.bytes_read), len(data)

    return wanted.mapInArrow(_over_bundles(path, work, _FETCHED), _FETCHED)


def round_trip(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) -> DataFrame:
    """Archive pages in the shared folder, read these columns of the archive back and remove it."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    found = cut(read(spark, path).select(*columns))
    discard(spark, path)
    return found
