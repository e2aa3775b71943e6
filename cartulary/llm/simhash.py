"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's sixteen 4-bit segments map to their bit counts, a point of a
16-dimensional integer grid.  Flipping a bit moves one count by one, so the
Manhattan distance of two points is a lower bound of the Hamming distance.
Two grid points at distance 2 or less share a grid point at distance 1 or less
from both, so each fingerprint is dealt to its own cell and to those one step
away (33 at most), the pairs of a cell are compared, and the Hamming distance
decides.  Only distinct fingerprints are dealt, and a cell yields a spanning
set of its links (never all its pairs): linear in the cell.

Cases: a null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle.  Links are between
fingerprints only: rows that share a doc_id come back one by one, and are not
linked by that.  A row with a null doc_id gets the component of its
fingerprint, null if no row there has a doc_id.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import components, cut, map_texts

SEED = 42
#: Differing bits of a link; the grid's shared points and the flips below are made for two.
DISTANCE = 2
#: Distinct fingerprints of a cell that one task compares; larger cells are dealt by single bit flips.
CELL_LIMIT = 1 << 16
#: Members of a cell of which all pairs are compared at once.
FEW = 16
ROWS_OUT = 1 << 15
FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, as an unsigned integer."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    h64 = xxhash.xxh64_intdigest
    k = n - shingle + 1
    hashes = np.fromiter([h64(joined[a:b], SEED) for a, b in zip(begins[:k].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, k)
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, and fp, the fingerprint as a signed long, for each row."""

    def work(texts: list[bytes | None]) -> dict:
        return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, work, [("fp", "bigint")], [doc_id, *carry], text)


def _cells(fps: DataFrame) -> DataFrame:
    """cell, fp: each fingerprint in its own cell and those a step away."""
    ones = F.lit(0x1111111111111111)
    counts = sum((F.shiftrightunsigned("fp", i).bitwiseAND(ones) for i in range(1, 4)), F.col("fp").bitwiseAND(ones))
    own = F.col("own")
    steps = [own]
    for i in range(16):
        nibble = F.shiftrightunsigned(own, 4 * i).bitwiseAND(F.lit(15))
        one = 1 << (4 * i)
        steps += [F.when(nibble < 4, own + F.lit(one)), F.when(nibble > 0, own - F.lit(one))]
    return fps.select("fp", counts.alias("own")).select("fp", F.explode(F.array_compact(F.array(*steps))).alias("cell"))


def _links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links, fewer than fp has members, that connect whatever is within DISTANCE."""
    n = len(fp)
    if n <= 48:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE
        a, b = a[near], b[near]
    else:
        # Within two bits of each other: a common value one flip away.  The first that has a value stands for it.
        keys = (fp[:, None] ^ FLIPS[None, :]).ravel()
        who = np.repeat(np.arange(n), len(FLIPS))
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        head = who[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        code = np.unique(head[~first] * n + who[~first])
        a, b = code // n, code % n
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            keep.append(k)
    return a[keep], b[keep]


def _compare(limit: int):
    """Rows sorted by cell and fp to links (u, v), and to the fingerprints of cells over limit (big, u = v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        held_cell = held = nothing  # the last cell so far, which may go on
        passing = None  # the cell over the limit whose rows go through
        outs: tuple[list, list, list] = ([], [], [])

        def put(u: np.ndarray, v: np.ndarray, big: bool = False) -> None:
            for o, x in zip(outs, (u, v, np.full(len(u), big)), strict=True):
                o.append(x)

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(o) if o else np.zeros(0) for o in outs]
            for o in outs:
                o.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["u", "v", "big"])

        def solve(cell: np.ndarray, fp: np.ndarray) -> None:
            """Whole cells, sorted."""
            if not len(cell):
                return
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(begins, len(cell)))
            bits = fp.view(np.uint64)
            few = np.repeat(sizes <= FEW, sizes)
            for k in range(1, min(FEW, int(sizes.max()))):
                at = np.flatnonzero((cell[k:] == cell[:-k]) & few[k:])
                at = at[np.bitwise_count(bits[at] ^ bits[at + k]) <= DISTANCE]
                put(fp[at], fp[at + k])
            for i in np.flatnonzero(sizes > FEW):
                own = fp[begins[i] : begins[i] + sizes[i]]
                if len(own) > limit:
                    put(own, own, True)
                else:
                    a, b = _links(own.view(np.uint64))
                    put(own[a], own[b])

        for batch in batches:
            cell, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fp"))
            if passing is not None:
                k = int(np.searchsorted(cell, passing, "right"))
                put(fp[:k], fp[:k], True)
                cell, fp = cell[k:], fp[k:]
                if len(cell):
                    passing = None
            if len(cell):
                cell, fp = np.concatenate([held_cell, cell]), np.concatenate([held, fp])
                last = int(np.searchsorted(cell, cell[-1], "left"))
                solve(cell[:last], fp[:last])
                held_cell, held = cell[last:], fp[last:]
                if len(held) > limit:
                    passing = held_cell[0]
                    put(held, held, True)
                    held_cell = held = nothing
            if sum(map(len, outs[0])) >= ROWS_OUT:
                yield out()
        solve(held_cell, held)
        yield out()

    return run


def links(fps: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(u, v): fingerprints within DISTANCE of each other, enough pairs to connect all that are; fps: distinct fp."""
    dealt = _cells(fps).repartition("cell").sortWithinPartitions("cell", "fp")
    got = cut(dealt.mapInArrow(_compare(cell_limit), "u bigint, v bigint, big boolean"))
    near = got.where("not big").select("u", "v").distinct()
    # Cells over the limit: dealt by the values one flip away; the least fingerprint of a value stands for it.
    big = got.where("big").select("u").distinct()
    flips = F.array(*[F.col("u").bitwiseXOR(F.lit(int(x))) for x in FLIPS.view(np.int64)])
    keyed = big.select(F.col("u").alias("v"), F.explode(flips).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("most")).where("u < most").select("key", "u")
    return near.unionAll(keyed.join(heads, "key").where("u < v").select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, cell_limit: int = CELL_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links of two bits or fewer).

    With columns to carry they follow, after root, which only the rows of one component share.
    """
    rows = cut(fingerprints(docs, doc_id, text, shingle, carry).withColumnRenamed(doc_id, "doc_id"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = classes.join(components(links(classes.select("fp"), cell_limit)).withColumnRenamed("node", "fp"), "fp", "left")
    linked = cut(linked.select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    of = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")))  # as in components, for a large one
    extra = ["root", *carry] if carry else []
    return rows.join(linked.join(of, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", *extra)
