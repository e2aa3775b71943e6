"""The prefix trie of conversations by an external mergesort that knows shared prefixes.

A turn is the 128-bit digest of its role and text, a conversation the path of
its turns' digests.  Paths are parted into ranges, of which each task sorts runs
of a bounded size; an entry of a run keeps the number of turns that it shares
with the entry before and only the turns after these.  Runs go to the shared
folder in blocks.  A loser tree merges the blocks of a range as the merge comes
to them; the numbers of shared turns decide most matches, so turns that are
known to be equal are not compared again.  The merged stream keeps the open
path on a stack and emits a node when the stream leaves it.

A node that reaches over the borders of ranges comes out in parts.  The border
of a range (the turns that its first path shares with the path before, its last
with the path after) tells which; all that is counted of a node adds up over its
parts, so these are joined by a sum for each node.  A range's size doesn't bound
a group of copies: equal paths are parted by conv_id.

Cases: rows without a conv_id belong to no conversation; null roles and texts
are empty; turns with the same number come in order of their digests, null
numbers first, repeated rows stay.  Extra columns are left out.  No
conversations: no nodes.  The digests of one conversation (20 bytes a turn) must
fit a task; texts never leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartulary.llm.common import cut, discard, stored
from cartulary.llm.merging import DIGEST, Merge, PathTree, shared_turns
from cartulary.operators import ordered

#: A conversation's shared beginning is that of the first one of its BRANCH.
BRANCH = 20
HEAD = 4
RANGE_BYTES = 64 << 20
MOST_RANGES = 10_000
RUN_BYTES = 16 << 20
#: Entries of a block and bytes of its turns.
BLOCK_ROWS = 512
BLOCK_BYTES = 1 << 20
#: Characters of a part of a list of ids.
LIST_CHARS = 1 << 16
BATCH_ROWS = 4_096


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: for each conversation its turns in order, each the hexadecimal digest and the words of the text."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    one = F.struct(
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)).alias("digest"),
        F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    ids = rows.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), one.alias("one")).where("conv_id is not null")
    return ids.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(convs: DataFrame, branch: int = BRANCH, head: int = HEAD) -> DataFrame:
    """Each conversation with its first crc32(conv_id) % head turns taken from the first one of its branch."""
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % branch
    heads = convs.where(F.col("conv_id") % branch == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, head - 1).alias("shared"))
    rows = convs.select("*", first.alias("first"), h.alias("h")).join(heads, "first", "left")
    begin = F.when(F.col("shared").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.expr("slice(shared, 1, h)"))
    return rows.select("conv_id", F.concat(begin, F.expr("slice(turns, h + 1, greatest(size(turns), 1))")).alias("turns"))


def items(convs: DataFrame) -> DataFrame:
    """conv_id, path (the digests in a row), words (of each turn)."""
    return convs.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.words").alias("words"))


_BLOCKS = "range int, kind int, first binary, first_id bigint, last binary, ids array<bigint>, shared array<int>, lengths array<int>, turns binary, words array<int>"


def sorted_runs(paths: DataFrame, ranges: int, run_bytes: int = RUN_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the runs: first and last paths, and of each entry the turns shared with the entry before, their number, and the rest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, size = TaskContext.get().partitionId(), [], 0

        def block(part: list[tuple]) -> list:
            shared = [0, *(shared_turns(a[0], b[0]) for a, b in zip(part, part[1:], strict=False))]
            turns = b"".join(p[DIGEST * n :] for (p, _, _), n in zip(part, shared, strict=True))
            words = [w for (_, _, ws), n in zip(part, shared, strict=True) for w in ws[n:]]
            return [at, 1, part[0][0], part[0][1], part[-1][0], [c for _, c, _ in part], shared, [len(p) // DIGEST for p, _, _ in part], turns, words]

        def blocks() -> Iterator[pa.RecordBatch]:
            rows.sort()
            part, held = [], 0
            for row in rows:
                part.append(row)
                held += len(row[0])
                if len(part) >= block_rows or held >= BLOCK_BYTES:
                    yield batch_of(block(part))
                    part, held = [], 0
            if part:
                yield batch_of(block(part))

        def batch_of(one: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(one, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "words")), strict=True):
                rows.append(row)
                size += len(row[0]) + 64
                if size >= run_bytes:
                    yield from blocks()
                    rows, size = [], 0
        yield from blocks()

    return paths.select("path", "conv_id", "words").repartitionByRange(ranges, "path", "conv_id").mapInArrow(run, _BLOCKS)


def borders(blocks: DataFrame) -> DataFrame:
    """For each range: before and after, the turns that its first path shares with the path before and its last with the one after (-1: there is none); tail, that many turns of the last."""
    ends = cut(blocks.groupBy("range").agg(F.min("first").alias("first"), F.max("last").alias("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, before, last path

        def out(after: int) -> pa.RecordBatch:
            number, before, last = held
            cols = [pa.array([number], pa.int32()), pa.array([before], pa.int32()), pa.array([after], pa.int32()), pa.array([last[: max(0, after) * DIGEST]], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["range", "before", "after", "tail"])

        for batch in batches:
            for number, first, last in zip(*(batch.column(c).to_pylist() for c in ("range", "first", "last")), strict=True):
                both = shared_turns(held[2], first) if held else -1
                if held:
                    yield out(both)
                held = number, both, last
        if held:
            yield out(-1)

    # One row for each range: the list of the ranges' borders, not their contents.
    return ends.repartition(1).sortWithinPartitions("range").mapInArrow(run, "range int, before int, after int, tail binary")


class _Node:
    __slots__ = ("children", "depth", "digest", "distinct", "ends", "key", "leaves", "least", "n", "opened", "rows", "taken", "tokens", "words")

    def __init__(self, depth: int, words: int, opened: bool, key: bytes | None) -> None:
        self.depth, self.words, self.opened, self.key = depth, words, opened, key
        self.n = self.children = self.leaves = self.tokens = self.distinct = self.taken = 0
        self.least: int | None = None
        self.digest = sha256()
        self.ends: list[str] = []
        self.rows: list[tuple] = []


class OpenPath:
    """The nodes of a range from its merged paths.  A node that other ranges have a part of (it lies on one of the two borders) has a key."""

    def __init__(self, number: int, before: int, after: int, tail: bytes) -> None:
        self.number, self.before, self.after, self.tail = number, before, after, tail
        self.out: list[tuple] = []
        self.stack = [self._open(0, 0, b"", before < 0)]
        self.latest = -1

    def _open(self, depth: int, words: int, path: bytes, opened: bool) -> _Node:
        on_border = not opened or (depth <= self.after and path[: depth * DIGEST] == self.tail[: depth * DIGEST])
        return _Node(depth, words, opened, sha256(path[: depth * DIGEST]).digest() if on_border else None)

    def add(self, path: bytes, conv_id: int, shared: int, words: list[int]) -> None:
        begins = self.latest < 0
        known = max(0, self.before) if begins else shared
        if not begins:
            self._leave(known)
        length = len(path) // DIGEST
        for depth in range(len(self.stack), length + 1):
            opened = depth > known
            if opened:
                self.stack[-1].children += 1
            self.stack.append(self._open(depth, words[depth - 1], path, opened))
        end = self.stack[length]
        end.n += 1
        end.least = conv_id if end.least is None else min(end.least, conv_id)
        self.latest = length
        if end.key is None:
            end.digest.update(f",{conv_id}".encode() if end.taken else str(conv_id).encode())
        else:
            end.ends.append(str(conv_id))
            if len(end.ends) >= LIST_CHARS // 16:
                self._list(end)
        end.taken += 1

    def _list(self, node: _Node) -> None:
        if node.ends:
            self.out.append((node.key, None, self.number, node.taken, ",".join(node.ends), *[None] * 8))
            node.ends = []

    def _leave(self, depth: int) -> None:
        """Close all nodes deeper than depth; the last conversation's own node is a leaf if it closes."""
        if depth < self.latest:
            self.stack[self.latest].leaves += 1
        while len(self.stack) - 1 > depth:
            self._close()

    def _close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        tokens = node.tokens + node.n * node.words
        distinct = node.distinct + (node.words if node.opened else 0)
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.leaves += node.leaves
            parent.tokens += tokens
            parent.distinct += distinct
        self._list(node)
        known = node.least if node.key is None else None
        for row in node.rows:  # children that wait for the smallest member
            self.out.append((None, node.key, None, None, None, *row[:2], known, *row[2:]))
        row = (node.least, node.depth, node.n, node.children, node.leaves, tokens - distinct, node.digest.hexdigest())
        if node.key is not None:
            self.out.append((node.key, parent and parent.key, self.number, None, None, *row[:2], None, *row[2:6], None))
        elif parent is None:
            self.out.append((None, None, None, None, None, *row[:2], None, *row[2:]))
        elif parent.key is not None:
            self.out.append((None, parent.key, None, None, None, *row[:2], None, *row[2:]))
        else:
            parent.rows.append(row)

    def end(self) -> None:
        self._leave(self.after)
        while self.stack:
            self._close()


_PARTS = "key binary, parent_key binary, range int, seq bigint, list string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _entries(ids: list[int], shared: list[int], lengths: list[int], turns: bytes, words: list[int]) -> Iterator[tuple]:
    """A block's entries as heads of a PathTree, with the words of their turns."""
    path, own, at = b"", [], 0
    for conv_id, n, length in zip(ids, shared, lengths, strict=True):
        to = at + length - n
        path, own = path[: n * DIGEST] + turns[at * DIGEST : to * DIGEST], own[:n] + words[at:to]
        at = to
        yield path, conv_id, n, own


def merged_nodes(blocks: DataFrame, edges: DataFrame, ranges: int) -> DataFrame:
    """The nodes and parts of nodes of each range: see _PARTS."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(_PARTS))
    names = ["range", "kind", "first", "first_id", "ids", "shared", "lengths", "turns", "words", "before", "after", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {c: batch.column(c)[i].as_py() for c in names}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        coming = read()
        waiting = next(coming, None)

        def of_range() -> Iterator[tuple]:
            nonlocal waiting
            while waiting is not None and waiting["kind"]:
                b = waiting
                yield (b["first"], b["first_id"]), _entries(b["ids"], b["shared"], b["lengths"], b["turns"], b["words"])
                waiting = next(coming, None)

        while waiting is not None:  # at the border row of a range, which comes before its blocks
            path = OpenPath(waiting["range"], waiting["before"], waiting["after"], waiting["tail"])
            waiting = next(coming, None)
            for head in Merge(PathTree(), of_range()):
                path.add(*head)
                if len(path.out) >= BATCH_ROWS:
                    yield batch_of(path.out)
                    path.out = []
            path.end()
            yield batch_of(path.out)

    both = blocks.drop("last").unionByName(edges.withColumns({"kind": F.lit(0), "first": F.lit(b""), "first_id": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    return both.repartition(ranges, "range").sortWithinPartitions("range", "kind", "first", "first_id").select(*names).mapInArrow(run, _PARTS)


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES, block_rows: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, turns): see _NODE."""
    spark = convs.sparkSession
    paths, paths_at = stored(items(convs))
    if ranges is None:
        size = paths.agg(F.sum(F.octet_length("path") + F.lit(64))).first()[0] or 0
        ranges = min(MOST_RANGES, 1 + size // range_bytes)
    blocks, blocks_at = stored(sorted_runs(paths, ranges, run_bytes, block_rows))
    parts, _ = stored(merged_nodes(blocks, borders(blocks), ranges))
    for path in (paths_at, blocks_at):  # all that reads them is written
        discard(spark, path)
    whole = parts.where("key is null")
    # The parts of nodes on borders add up; their lists of ids follow each other by range.
    sums = parts.where("key is not null and list is null").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )

    def step(state, text):
        digest, n = state
        digest.update(f",{text}".encode() if n else text.encode())
        return digest, n + 1

    lists = ordered.fold(parts.where("list is not null"), ["key"], ["range", "seq"], ["list"], lambda: (sha256(), 0), step, lambda s: (s[0].hexdigest(),), "ends_sha256 string")
    shared = cut(sums.join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))))
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    done = whole.where("parent_key is null").select(*_NODE)
    hanging = whole.where("parent_key is not null").select("parent_key", *_NODE).unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select("parent_key", *_NODE))
    return done.unionAll(hanging.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above")).select(*_NODE))
