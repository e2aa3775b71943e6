"""Benchmark decontamination by suffix arrays over shards of the training texts.

First the texts are gone through once.  A shard is what one task reads of them,
up to SHARD_BYTES; its words are 64-bit hashes.  Stretches of which every few
words also follow each other in some item (told by bits of the benchmark's
grams) are laid in a row; no other position can begin a match.  Prefix doubling
sorts their suffixes, and the shards are written apart: hashes, suffix array,
and the document and word of each position.

Then every test suffix that begins a window is found in each shard by binary
search: the interval of training suffixes that start with its window gives the
places.  The place of the whole test suffix in the order, searched the same way,
gives the longest verbatim matches: the two test suffixes around a training
suffix share the most with it.  The benchmark comes in blocks of about
BLOCK_BYTES (words counted by what they take in memory), one after the other
against the same shards, so neither the driver nor a task holds more of it than
a block and the bits, which have a fixed limit; an item is never parted, and
shares its block with others.

What is found hangs on a document's text alone, so it is brought back by the
text's digest: equal texts are one, and Spark broadcasts the findings where
their table is small, and shuffles where it isn't.

Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII characters.
A window is `window` consecutive words of an item; an item with fewer words,
but one at least, is one window.  Cases: null and wordless texts are hit by
nothing, null and wordless items have no window, an empty benchmark leaves all
documents clean.  Items with one item_id count once; items with a null id hit as
others do and are one null at the end of the list.  Repeated rows of the
benchmark are read once.  Repeated documents are judged alike; other columns are
left out.  A document or an item of any length is one: it may make its shard or
its block larger than the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cartulary.llm import rolling
from cartulary.llm.common import cut, discard, slices, stored

WINDOW = 10
#: Bytes of a block: its texts, and WORD_BYTES for each word.
BLOCK_BYTES = 16 << 20
WORD_BYTES = 16
#: Text of a shard, and positions of its suffix array.
SHARD_BYTES = 256 << 20
SHARD_WORDS = 1 << 19
#: Consecutive words that a place must share with the benchmark to be looked at.
GRAM = 3
#: Bits for each gram of the benchmark, and in all (what goes beyond lets more places through, no fewer).
GRAM_BITS = 16
MOST_BITS = 1 << 28
#: Words that a worker remembers the hashes of.
REMEMBERED = 500_000

_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


_WORD = np.array([c != 0x20 for c in _TABLE])


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """The words of texts as bytes: the places where one begins; 0 for null."""

    def one(text: bytes | None) -> int:
        if not text:
            return 0
        inside = _WORD[np.frombuffer(text, np.uint8)]
        return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))

    return texts.map(one, na_action=None).astype("int64")


def _in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq sorted by the suffixes' first depth items (ties by position)."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if rank[order[-1]] == n:
            break
        k *= 2
    return order


class _Hashes(dict):
    """Of each word a hash from 2 on, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = max(2, xxhash.xxh3_64_intdigest(word))
        return out


_HASHES = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _prefixes(seq: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The length items from each of at as bytes that sort as the items do; zeros behind the end."""
    out = np.zeros((len(at), length), ">u8")
    for j in range(length):
        inside = at + j < len(seq)
        out[inside, j] = seq[at[inside] + j]
    return out.view(f"S{8 * length}").ravel()


def _gram_hashes(seq: np.ndarray, at: np.ndarray, size: int, window: int) -> np.ndarray:
    """A hash of the size items from each of at, for items with windows of that length."""
    h = np.full(len(at), window, np.uint64)
    for j in range(size):
        h = rolling.mixed(h ^ seq[at + j])
    return h


class Grams:
    """Bits of the hashes of all items' grams, by the length of their windows."""

    def __init__(self, words: int, window: int = WINDOW) -> None:
        self.window, self.lengths = window, set()
        self.bits = np.zeros(1 << max(7, min(MOST_BITS, words * GRAM_BITS).bit_length() - 3), np.uint8)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h % np.uint64(8 * len(self.bits))
        return h >> np.uint64(3), (h & np.uint64(7)).astype(np.uint8)

    def add(self, texts: Iterator[bytes | None]) -> None:
        for text in texts:
            seq = hashed(words_of(text))
            if len(seq):
                n = min(self.window, len(seq))
                self.lengths.add(n)
                g = min(GRAM, n)
                byte, bit = self._place(_gram_hashes(seq, np.arange(len(seq) - g + 1), g, n))
                np.bitwise_or.at(self.bits, byte, np.uint8(1) << bit)

    def stretches(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions in runs, within one document, of words whose every gram items of one length of windows have too, long enough for it."""
        kept = np.zeros(len(ids), bool)
        for n in sorted(self.lengths):
            g = min(GRAM, n)
            end = len(ids) - g + 1
            if end <= 0:
                continue
            at = np.flatnonzero(doc[:end] == doc[g - 1 :])
            byte, bit = self._place(_gram_hashes(ids, at, g, n))
            at = at[(self.bits[byte] >> bit) & 1 > 0]
            if len(at):
                run = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])]))
                at = at[np.bincount(run)[run] >= n - g + 1]
                for j in range(g):
                    kept[at + j] = True
        return np.flatnonzero(kept)


class Shard:
    """Stretches of many documents in a row, a zero after each, and their suffixes in order."""

    def __init__(self, grams: Grams) -> None:
        self.grams, self.keys, self.size, self.words = grams, [], 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: list[str], texts: list[bytes]) -> None:
        split = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        ids = hashed([w for ws in split for w in ws])
        doc = np.repeat(np.arange(len(texts)), counts)
        kept = self.grams.stretches(ids, doc)
        self.size += sum(map(len, texts))
        if not len(kept):
            return
        first = np.concatenate([[0], np.cumsum(counts)])[doc[kept]]
        gap = np.concatenate([(np.diff(kept) > 1) | (np.diff(doc[kept]) > 0), [True]])
        place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(gap[:-1])])
        seq, own, word = np.zeros(place[-1] + 2, np.uint64), np.full(place[-1] + 2, -1, np.int32), np.full(place[-1] + 2, -1, np.int32)
        some, which = np.unique(doc[kept], return_inverse=True)
        seq[place], own[place], word[place] = ids[kept], which + len(self.keys), kept - first
        self.keys += [keys[i] for i in some.tolist()]
        self.parts.append((seq, own, word))
        self.words += len(seq)

    def row(self) -> dict[str, object]:
        """keys; seq, own, word and order, the suffix array of what is no zero, as bytes."""
        seq, own, word = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], seq == 0]))).max())
        order = suffix_array(seq, longest + 1)
        return {"keys": self.keys, "seq": seq.tobytes(), "own": own.tobytes(), "word": word.tobytes(), "order": order[seq[order] > 0].astype(np.int32).tobytes()}


_SHARD = "keys array<string>, seq binary, own binary, word binary, order binary"


def shards(texts: DataFrame, grams, shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each shard (see Shard.row) of texts (key, text), null texts left out.  grams: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(grams.value)

        def out() -> pa.RecordBatch:
            row = shard.row()
            return pa.RecordBatch.from_arrays([pa.array([row["keys"]], pa.list_(pa.string())), *(pa.array([row[c]], pa.binary()) for c in ("seq", "own", "word", "order"))], names=["keys", "seq", "own", "word", "order"])

        for batch in batches:
            for part in slices(batch, "text"):
                shard.add(part.column("key").to_pylist(), part.column("text").to_pylist())
                if shard.size >= shard_bytes or shard.words >= shard_words:
                    if shard.words:
                        yield out()
                    shard = Shard(grams.value)
        if shard.words:
            yield out()

    return texts.select("key", F.col("text").cast("binary").alias("text")).where("text is not null").mapInArrow(run, _SHARD)


class Tests:
    """A block of items: their words in a row with zeros between, the order of their suffixes, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.window = window
        texts: dict[bytes, set[str | None]] = {}
        for item, text in items:
            texts.setdefault(b" ".join(words_of(text)), set()).add(item)
        texts.pop(b"", None)
        parts = [np.append(hashed(text.split()), np.uint64(0)) for text in texts]
        lengths = np.array([len(p) - 1 for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.ids = _in_order(set().union(*texts.values()) if texts else set())
        place = {x: i for i, x in enumerate(self.ids)}
        owners = [np.array(sorted(place[x] for x in own), np.int32) for own in texts.values()]
        #: The items of text k are owner[owned[k] : owned[k + 1]].
        self.owned = np.cumsum([0, *map(len, owners)])
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        self.text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        left = np.repeat(np.cumsum(lengths + 1) - 1, lengths + 1) - np.arange(len(self.words))  # words from here to the text's end
        size = np.minimum(lengths, window)[self.text] if len(lengths) else np.zeros(0, np.int64)
        order = suffix_array(self.words, int(lengths.max()) + 1 if len(lengths) else 1)
        #: For each length of windows their first words' positions, in order of the suffixes, and where each distinct one begins.
        self.starts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            at = order[(size == n)[order] & (left >= n)[order]]
            keys = _prefixes(self.words, at, n)
            self.starts[n] = at, np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(at))

    def items_of(self, length: int, windows: np.ndarray) -> np.ndarray:
        """Numbers of the items that have any of these windows."""
        at, begins = self.starts[length]
        texts = np.unique(self.text[np.concatenate([at[begins[i] : begins[i + 1]] for i in windows.tolist()])])
        return np.unique(np.concatenate([self.owner[self.owned[k] : self.owned[k + 1]] for k in texts.tolist()]))


class Search:
    """Test suffixes in the suffix array of one shard."""

    def __init__(self, seq: np.ndarray, order: np.ndarray, tests: Tests) -> None:
        self.seq, self.order, self.tests = seq, order, tests
        #: Test windows looked up in the shard.
        self.searched = 0
        # Zeros end a match on either side: for the hashes each is a value of its own.
        ends = [rolling.mixed(np.arange(len(x), dtype=np.uint64) + np.uint64(k << 40)) for k, x in ((1, seq), (2, tests.words))]
        self.mine, self.theirs = (rolling.Windows(np.where(x > 0, rolling.mixed(x), e)) for x, e in zip((seq, tests.words), ends, strict=True))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct test window of that length the training suffixes that start with it: from, to in the order."""
        at, begins = self.tests.starts[length]
        asked, here = _prefixes(self.tests.words, at[begins[:-1]], length), _prefixes(self.seq, self.order, length)
        self.searched += len(asked)
        return np.searchsorted(here, asked, "left"), np.searchsorted(here, asked, "right")

    def shared(self, ranks: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Words that training suffixes (by rank) and test suffixes (by position) have in common, by halving."""
        at = self.order[ranks].astype(np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.minimum(len(self.seq) - at, len(self.tests.words) - to)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.mine.at(at, mid) == self.theirs.at(to, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def places(self, to: np.ndarray) -> np.ndarray:
        """How many training suffixes are smaller than each test suffix, by binary search over whole suffixes."""
        lo, hi = np.zeros(len(to), np.int64), np.full(len(to), len(self.order), np.int64)
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(self.order) - 1)
            n = self.shared(mid, to)
            a, b = self.seq[self.order[mid] + n], self.tests.words[to + n]  # zeros at the latest
            right = open_ & ((a < b) | ((a == 0) & (b == 0)))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    def longest(self, ranks: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of each training suffix the most words that it shares with one of the test suffixes to, which are in order."""
        places, most = self.places(to), np.zeros(len(ranks), np.int64)
        after = np.searchsorted(places, ranks, "right")
        for near, inside in ((after - 1, after > 0), (after, after < len(to))):
            most[inside] = np.maximum(most[inside], self.shared(ranks[inside], to[near[inside]]))
        return most


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the sorted keys with its values."""
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1 if len(keys) else np.zeros(0, np.int64)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        yield int(keys[a]), values[a:b]


def match_shard(row: dict, tests: Tests) -> tuple[list[tuple[str, int, list[list[int]], list[str | None]]], Search]:
    """key, longest match, spans of hit words and items of each document of the shard that is hit; and the search."""
    seq, own, word, order = (np.frombuffer(row[c], t) for c, t in (("seq", np.uint64), ("own", np.int32), ("word", np.int32), ("order", np.int32)))
    search = Search(seq, order, tests)
    steps = np.zeros(len(seq) + 1, np.int64)
    items: dict[int, list[np.ndarray]] = {}
    longest = np.zeros(len(row["keys"]), np.int64)
    for length, (at, begins) in tests.starts.items():
        lo, hi = search.windows(length)
        which = np.flatnonzero(hi > lo)
        if not len(which):
            continue
        sizes = (hi - lo)[which]
        ranks = np.arange(sizes.sum()) + np.repeat(lo[which] - (np.cumsum(sizes) - sizes), sizes)
        found = order[ranks]
        np.add.at(steps, found, 1)
        np.add.at(steps, found + length, -1)
        np.maximum.at(longest, own[found], length)
        if length == tests.window:  # of shorter items the window is all there is
            to = np.concatenate([at[begins[i] : begins[i + 1]] for i in which.tolist()])
            np.maximum.at(longest, own[found], search.longest(ranks, to))
        pairs = np.unique(own[found].astype(np.int64) * len(begins) + np.repeat(which, sizes))
        owner, number = np.divmod(pairs, len(begins))
        for d, mine in _groups(owner, number):
            items.setdefault(d, []).append(tests.items_of(length, mine))
    hit = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    out = []
    # Positions of a document come in order in a shard, and documents one after the other.
    for d, at in _groups(own[hit], word[hit]):
        numbers = items[d]
        ends = np.flatnonzero(np.diff(at) > 1)
        spans = np.column_stack([at[np.append(0, ends + 1)], np.append(at[ends], at[-1]) - at[np.append(0, ends + 1)] + 1]).tolist()
        out.append((row["keys"][d], int(longest[d]), spans, [tests.ids[i] for i in np.unique(np.concatenate(numbers)).tolist()]))
    return out, search


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> tuple[int, int, DataFrame]:
    """The distinct items with their block, the number of blocks (of about limit bytes each) and of words."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").distinct()
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")
    total = rows.agg(F.sum(F.octet_length("text") + WORD_BYTES * words + 64).alias("size"), F.sum(words).alias("words")).first()
    n = 1 + (total["size"] or 0) // limit
    return n, total["words"] or 0, rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))


def _items(blocks: DataFrame, n: int, number: int) -> list[tuple[str | None, bytes]]:
    part = blocks if n == 1 else blocks.where(F.col("block") == number)
    return [(r["item"], r.text.encode()) for r in part.collect()]


_HITS = "key string, block bigint, longest bigint, spans array<array<bigint>>, items array<string>"


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return out


def _merged(hits: DataFrame) -> DataFrame:
    """One row for each key from those of its blocks (as many as the benchmark has at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                spans = _union([s for p in parts for s in p["spans"]])
                out.append((key, sum(n for _, n in spans), max(p["longest"] for p in parts), spans, _in_order({i for p in parts for i in p["items"]})))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["key", "n_hit", "longest", "spans", "items"])

    # A text that many documents have may be found in many shards, always alike.
    each = hits.groupBy("key", "block").agg(F.first(F.struct("longest", "spans", "items")).alias("part"))
    rows = each.groupBy("key").agg(F.collect_list("part").alias("parts"))
    return rows.mapInArrow(run, "key string, n_hit bigint, longest bigint, spans array<array<bigint>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns keep and a struct `__found`, for each row.

    __found: n_words; n_hit, the words in occurring windows; longest, the most
    words in a row, a window at least, that are also found in a row in one item;
    spans, start and length of each stretch of hit words; items, the
    sorted ids of the items with occurring windows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    n, words, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    blocks = cut(blocks)  # read twice, block by block
    grams = Grams(words, window)
    for k in range(n):
        grams.add(t for _, t in _items(blocks, n, k))
    body = F.col(f"`{text}`").cast("string")
    made, shards_at = stored(shards(docs.select(F.md5(body).alias("key"), body.alias("text")), sc.broadcast(grams), shard_bytes, shard_words))
    hits, paths = None, []
    for k in range(n):
        tests = sc.broadcast(Tests(_items(blocks, n, k), window))

        def run(batches: Iterator[pa.RecordBatch], tests=tests, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found, _ = match_shard({c: batch.column(c)[i].as_py() for c in ("keys", "seq", "own", "word", "order")}, tests.value)
                    cols = list(zip(*found, strict=True)) or [[]] * 4
                    kinds = [pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
                    key, longest, spans, items = (pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True))
                    yield pa.RecordBatch.from_arrays([key, pa.array([k] * len(key), pa.int64()), longest, spans, items], names=["key", "block", "longest", "spans", "items"])

        part, path = stored(made.mapInArrow(run, _HITS))
        paths.append(path)
        hits = part if hits is None else hits.unionAll(part)
    found, _ = stored(_merged(hits))
    for path in (shards_at, *paths):
        discard(spark, path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.md5(body).alias("key"), word_count(body.cast("binary")).alias("n_words")).join(found, "key", "left")
    zero = F.lit(0).cast("bigint")
    made_of = F.struct("n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("longest", zero).alias("longest"), F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.select("kept.*", made_of.alias("__found"))
