"""Exact top-k inner products by KD-trees over shards of the vectors.

A task builds trees over the rows that it scans, so vectors are never shuffled:
shards of a bounded size, each split at the median of the dimension in which its
box is widest, down to leaves of a few rows, every node with the tight box of its
points and their smallest id.  Trees go to the shared folder, a row each.

Queries come in blocks of a bounded size, and a block goes to the tasks that hold
the trees.  The box of a node bounds the inner product with a query from above;
from the root on the node with the greatest bound is opened next, and once k
candidates are known the search ends at the first bound below the kth.  That kth
score is handed on: one shard is searched ahead for all, and within a task from
shard to shard.  Each task returns k rows a query at most; Spark ranks them.

Components are turned into floor(scale * x).  Scores are exact integers: doubles
where no sum can leave 2^53, Python's integers elsewhere; components and scores
outside a long end at its limits.  Cases: a vector that is null or holds a null
or non-finite component takes no part, nor does a row without an id; of vectors
of unequal length the shorter one counts as followed by zeros (so an empty one
scores 0 with all).  Rows with the query's id are the query's own; repeated rows
are candidates, and queries, each for itself.  Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.llm.common import stored

SCALE = 64
K = 20
LEAF_ROWS = 128
SHARD_BYTES = 16 << 20
#: Components of the queries of a block, in bytes.
BLOCK_BYTES = 32 << 20
#: Bounds that are worked out at a time.
BOUNDS = 1 << 21
_EXACT = 1 << 53


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: the rows that take part, with floor(scale * x) as longs."""
    kept = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = float((1 << 63) - 1024)
    return kept.where(finite).select("vec_id", F.transform("x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(top)), F.lit(-top))).cast("bigint")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists as rows of longs, zeros behind shorter ones."""
    ends = column.offsets.to_numpy()
    lengths, values = np.diff(ends), column.values.to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values[ends[0] : ends[-1]].reshape(len(lengths), width) if width else np.zeros((len(lengths), 0), np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values[ends[0] : ends[-1]]
    return out


def _wide(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


class Tree:
    """Points and their ids in the order of the leaves; node i has the children 2i and 2i + 1, the root is 1."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        n, depth = len(ids), 0
        while n >> depth > leaf_rows:
            depth += 1
        nodes = 2 << depth
        order = np.arange(n)
        self.begin, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.low, self.high = np.zeros((nodes, points.shape[1]), np.int64), np.zeros((nodes, points.shape[1]), np.int64)
        self.least = np.zeros(nodes, np.int64)
        self.end[1] = n
        for node in range(1, nodes):
            a, b = self.begin[node], self.end[node]
            own = points[order[a:b]]
            self.low[node], self.high[node], self.least[node] = own.min(axis=0), own.max(axis=0), ids[order[a:b]].min()
            if 2 * node < nodes:
                middle = (b - a) // 2
                if points.shape[1]:
                    widest = int(np.argmax(self.high[node].astype(float) - self.low[node]))
                    order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
                self.begin[2 * node], self.end[2 * node], self.begin[2 * node + 1], self.end[2 * node + 1] = a, a + middle, a + middle, b
        self.ids, self.points = ids[order], points[order]

    def row(self) -> dict[str, bytes | int]:
        """As columns; integers in the fewest bytes."""
        kind = next(t for t in (np.int16, np.int32, np.int64) if self.low.size == 0 or (self.low.min() >= np.iinfo(t).min and self.high.max() <= np.iinfo(t).max))
        many = {c: getattr(self, c).astype(kind).tobytes() for c in ("low", "high", "points")}
        return {"n": len(self.ids), "nodes": len(self.begin), "width": self.points.shape[1], "size": np.dtype(kind).itemsize, **many, **{c: getattr(self, c).tobytes() for c in ("ids", "begin", "end", "least")}}

    @classmethod
    def read(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        kind = np.dtype(f"i{row['size']}")
        for c, n in (("low", row["nodes"]), ("high", row["nodes"]), ("points", row["n"])):
            setattr(tree, c, np.frombuffer(row[c], kind).reshape(n, row["width"]))
        for c in ("ids", "begin", "end", "least"):
            setattr(tree, c, np.frombuffer(row[c], np.int64))
        return tree


_TREES = {"n": "bigint", "nodes": "bigint", "width": "bigint", "size": "bigint", **dict.fromkeys(("low", "high", "points", "ids", "begin", "end", "least"), "binary")}


def trees(vectors: DataFrame, shard_bytes: int = SHARD_BYTES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """shard, and a tree (see Tree.row) over each shard of vectors (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, rows, width = [], [], 0, 0

        def tree() -> pa.RecordBatch:
            row = Tree(np.concatenate(ids), _wide(points), leaf_rows).row()
            return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.binary() if t == "binary" else pa.int64()) for c, t in _TREES.items()], names=list(_TREES))

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = _matrix(batch.column("v"))
                if rows and (rows + len(found)) * max(width, found.shape[1], 1) * 8 > shard_bytes:
                    yield tree()
                    ids, points, rows, width = [], [], 0, 0
                ids.append(batch.column("vec_id").to_numpy())
                points.append(found)
                rows, width = rows + len(found), max(width, found.shape[1])
        if rows:
            yield tree()

    made = vectors.select("vec_id", "v").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _TREES.items()))
    return made.withColumn("shard", F.monotonically_increasing_id())


class Searches:
    """The queries of a block and the best candidates so far: score and id, from the best to the kth."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.ids, self.points, self.k = ids, points, k
        #: Scores that k candidates reach, wherever they are; -inf if that isn't known.
        self.floors = np.full(len(ids), -np.inf, object) if floors is None else floors
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        #: Points compared, of all that there are.
        self.compared = 0

    def visit(self, tree: Tree) -> None:
        width = min(self.points.shape[1], tree.points.shape[1])
        most = [int(np.abs(x[:, :width].astype(float)).max()) if x[:, :width].size else 0 for x in (self.points, tree.points)]
        kind = np.float64 if most[0] * most[1] * max(1, width) < _EXACT else object
        points, low, high = (x[:, :width].astype(kind) for x in (tree.points, tree.low, tree.high))
        step = max(1, BOUNDS // len(low))
        for at in range(0, len(self.ids), step):
            queries = self.points[at : at + step, :width].astype(kind)
            if width:
                bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
            else:
                bounds = np.zeros((len(queries), len(low)))
            for i, query in enumerate(queries):
                self._search(at + i, query, bounds[i].tolist(), tree, points)

    def _search(self, i: int, query: np.ndarray, bounds: list, tree: Tree, points: np.ndarray) -> None:
        own, k, leaves = int(self.ids[i]), self.k, len(bounds) // 2
        best = [(s, -v) for s, v in self.best[i]]  # a heap with the worst at its top
        heapq.heapify(best)
        floor = self.floors[i]
        opened = [(-bounds[1], 1)]
        while opened:
            bound, node = heapq.heappop(opened)
            kth = best[0] if len(best) == k else None
            if -bound < floor or (kth is not None and -bound < kth[0]):
                break  # no node that is left can reach the kth score
            if kth is not None and -bound == kth[0] and tree.least[node] > -kth[1]:
                continue  # ties only, and with greater ids
            if node < leaves:
                heapq.heappush(opened, (-bounds[2 * node], 2 * node))
                heapq.heappush(opened, (-bounds[2 * node + 1], 2 * node + 1))
                continue
            a, b = tree.begin[node], tree.end[node]
            self.compared += int(b - a)
            scores = points[a:b] @ query if points.shape[1] else np.zeros(b - a)
            least = floor if kth is None else max(floor, kth[0])
            for j in np.flatnonzero(scores >= least).tolist():
                vec = int(tree.ids[a + j])
                if vec != own:
                    found = (int(scores[j]), -vec)
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        self.best[i] = [(s, -v) for s, v in sorted(best, reverse=True)]


def _clipped(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _searched(shards: DataFrame, queries, floors, k: int) -> DataFrame:
    """query (its place in the block), vec_id, score: the best of each task's shards.  queries, floors: broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = queries.value
        searches = Searches(ids, points, k, floors.value if floors is not None else None)
        for batch in batches:
            for row in range(batch.num_rows):
                searches.visit(Tree.read({c: batch.column(c)[row].as_py() for c in _TREES}))
        sizes = [len(b) for b in searches.best]
        found = [x for b in searches.best for x in b]
        cols = [np.repeat(np.arange(len(ids)), sizes), np.repeat(ids, sizes), np.array([v for _, v in found], np.int64), np.array([_clipped(s) for s, _ in found], np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "vec_id", "score"])

    return shards.select(*_TREES).mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")


def search(shards: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id, v) the k best of the written trees."""
    spark = shards.sparkSession
    size = queries.agg(F.sum((F.size("v") + 1).cast("bigint") * 8)).first()[0] or 0
    blocks = 1 + size // block_bytes
    if blocks > 1:  # dealt out by chance, so that equal ids or vectors don't meet; written, so that it stays so
        queries, _ = stored(queries.withColumn("block", F.floor(F.rand(7) * blocks)).repartition("block"))
    seed = shards.agg(F.min("shard")).first()[0]
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    out: DataFrame | None = None
    for number in range(blocks):
        rows = (queries.where(F.col("block") == number) if blocks > 1 else queries).select("vec_id", "v").toArrow()
        parts = [_matrix(c) for c in rows.column("v").chunks]
        ids = rows.column("vec_id").to_numpy().astype(np.int64)
        sent = spark.sparkContext.broadcast((ids, _wide(parts) if parts else np.zeros((0, 0), np.int64)))
        # One shard searched ahead: what its kth reaches no other shard has to look below.
        ahead = _searched(shards.where(F.col("shard") == F.lit(seed)), sent, None, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        floors = np.full(len(ids), -np.inf, object)
        for r in ahead.collect():
            floors[r.query] = r.kth if abs(r.kth) < 1 << 62 else -np.inf
        found = _searched(shards, sent, spark.sparkContext.broadcast(floors), k)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            best, _ = stored(best)
        out = best if out is None else out.unionAll(best)
    return out


def nearest(rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, shard_bytes: int = SHARD_BYTES, leaf_rows: int = LEAF_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """search for the rows of which is_query (a condition on vec_id) holds, among all rows."""
    vectors = quantised(rows, vec_id, vector, scale)
    shards, _ = stored(trees(vectors, shard_bytes, leaf_rows))
    return search(shards, vectors.where(is_query), k, block_bytes)
