import random

import pytest
import regex

from cartulary.llm import contamination

WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    at: dict[tuple, set] = {}
    for i, t in items:
        w = WORDS.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            at.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = WORDS.findall(lower(t or ""))
        hit, found, longest = [False] * len(w), set(), 0
        for n in {len(k) for k in at}:
            for k in range(len(w) - n + 1):
                if who := at.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= who
        for i, t2 in items:  # the longest verbatim match of at least a window
            v = WORDS.findall(lower(t2 or ""))
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n and n >= min(window, len(v)):
                        longest = max(longest, n)
        out.append((d, len(w), sum(hit), longest, sorted(found)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, item), (2, "Zwei WÖRTER"), (3, None), (4, "..."), (5, "six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (5, "solo"), (6, item + " more")]
    docs = [
        (1, "x " + item + " y"), (2, "ONE, two! three four-five six seven eight nine ten"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "zwei wörter zwei WÖRTER, zwei"),
        (7, "the solo " * 3), (8, "six seven eight nine ten eleven twelve thirteen fourteen fifteen one two"), (8, "nine ten"), (None, item), (9, "ten " + item[:40] + " " + item), (10, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    ]
    want = brute(docs, items, 10)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, n_hit string").repartition(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for sizes in ({}, {"block_bytes": 60}, {"block_bytes": 300, "shard_bytes": 1, "shard_words": 1}):  # one block and shard, and several
        got = contamination.decontaminate(df, bench, ["doc_id"], **sizes).select("doc_id", "__found.*").collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.longest, list(r["items"])) for r in got], key=repr) == want
        for r in got:
            assert sum(n for _, n in r.spans) == r.n_hit


def matched(docs, items, window=10, per_shard=1_000):
    """doc, words, hit words, longest match and items by shards of so many texts; and the searches of the shards."""
    grams = contamination.Grams(sum(len(t.split()) for _, t in items), window)
    grams.add(t.encode() for _, t in items)
    tests = contamination.Tests([(i, t.encode()) for i, t in items], window)
    found, searches = {}, []
    for k in range(0, len(docs), per_shard):
        shard = contamination.Shard(grams)
        for d, t in docs[k : k + per_shard]:
            shard.add([str(d)], [t.encode()])
        if shard.words:
            rows, search = contamination.match_shard(shard.row(), tests)
            found |= {key: rest for key, *rest in rows}
            searches.append(search)
    out = []
    for d, t in docs:
        longest, spans, own = found.get(str(d), (0, [], []))
        out.append((d, len(contamination.words_of(t.encode())), sum(n for _, n in spans), longest, own))
    return sorted(out, key=repr), searches


def test_longest_match_lies_in_one_item():
    w = [f"w{i}" for i in range(13)]
    got, _ = matched([(1, " ".join(w)), (2, "w3 w4")], [("1", " ".join(w[1:12])), ("2", " ".join(w[2:13]))])
    assert got == [(1, 13, 12, 11, ["1", "2"]), (2, 2, 0, 0, [])]


@pytest.mark.parametrize("window", [10, 3, 1])
def test_random_texts(window):
    """Few words and many repeats; shards with fewer and with more suffixes than there are tests."""
    rng = random.Random(window)
    for round_ in range(12):
        vocabulary = [f"v{i}" for i in range(3 + 4 * (round_ % 3))]
        text = lambda n: " ".join(rng.choice([*vocabulary, "x" * rng.randrange(1, 3)]) for _ in range(n))
        items = [(str(i % 5), text(rng.randrange(0, 25))) for i in range(rng.choice([2, 12]))]
        docs = [(i, text(rng.choice([0, 5, 30, 90]))) for i in range(rng.choice([1, 8]))]
        if round_ % 2:
            docs.append((99, "y " + items[0][1] + " y " + items[-1][1]))
        assert matched(docs, items, window, rng.choice([1, 3, 100]))[0] == brute(docs, items, window)


def test_every_test_window_is_searched_in_every_shard():
    """The direction never turns, however few suffixes a shard has."""
    rng = random.Random(8)
    items = [(str(i), " ".join(f"w{rng.randrange(50)}" for _ in range(60))) for i in range(20)]
    windows = {tuple(t.split()[k : k + 10]) for _, t in items for k in range(51)}
    docs = [(i, "so " + " ".join(items[i][1].split()[:12])) for i in range(6)]
    _, searches = matched(docs, items, per_shard=2)
    assert len(searches) == 3 and all(s.searched == len(windows) > len(s.order) for s in searches)


def test_long_items_and_documents(spark):
    """An item larger than a block, and a document larger than a shard with two of its passages."""
    rng = random.Random(9)
    item = [f"w{rng.randrange(3000)}" for _ in range(8000)]
    body = [f"x{rng.randrange(900)}" for _ in range(30_000)]
    body[5_000:5_040], body[29_000:29_015] = item[100:140], item[7_980:7_995]
    docs = spark.createDataFrame([(1, " ".join(body)), (2, "short one"), (3, " ".join(item[40:49]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", "nothing of this is anywhere else at all my friend you see")], "item_id string, text string")
    got = {r.doc_id: r for r in contamination.decontaminate(docs, bench, ["doc_id"], block_bytes=4_000, shard_bytes=10_000).select("doc_id", "__found.*").collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].longest, got[1].spans, got[1]["items"]) == (30_000, 55, 40, [[5_000, 40], [29_000, 15]], ["a"])
    assert got[2].n_hit == got[3].n_hit == 0


def test_full_bits_only_let_more_through():
    rng = random.Random(10)
    items = [(str(i), " ".join(f"w{rng.randrange(9)}" for _ in range(30))) for i in range(30)]
    docs = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(200)) + " " + items[i][1]) for i in range(5)]
    want = matched(docs, items)[0]
    small = contamination.MOST_BITS
    try:
        contamination.MOST_BITS = 1024
        assert matched(docs, items)[0] == want == brute(docs, items, 10)
    finally:
        contamination.MOST_BITS = small


def test_suffix_array_by_sorting():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        seq = rng.integers(0, 3, n)
        got = contamination.suffix_array(seq, n)
        assert got.tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = contamination.decontaminate(messy, none, messy.columns)
    assert got.count() == messy.count() and got.where("__found.n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination.decontaminate(empty, some, ["doc_id"]).count() == 0
    assert set(messy.columns) < set(got.columns)


def test_items_without_id_equal_the_sql(spark, tmp_path):
    from cartulary.llm import queries
    from tests.oracle import TABLES, compare

    bench = [(None, "only a row without an id has this long passage of words"), (None, "another one"), (7, "another one"), *[(8, "said again")] * 50]
    docs = [(1, "so " + bench[0][1]), (2, "another one, said again"), (3, "clean"), (4, None)]
    spark.createDataFrame(bench, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / ("b" if t == "benchmark" else "d")).glob("*.parquet")))
    assert compare(spark, queries.QUERIES["op3_decontamination"], queries.ORACLES["op3_decontamination"], str(tmp_path)) == 4
    n, words, blocks = contamination._blocks(spark.createDataFrame(bench, "item_id bigint, text string"), "item_id", "text", 1 << 10)
    assert n == 1 and len(contamination._items(blocks, n, 0)) == 4 and words == 18
