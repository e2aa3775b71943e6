import hashlib
import os
import random
import re
import zlib

import pytest

from cartulary.llm import trie
from cartulary.llm.merging import DIGEST, Merge, PathTree, shared_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """The nodes by a dictionary of prefixes."""
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            conv.setdefault(c, []).append((t is not None, t or 0, digest, (r, x)))
    conv = {c: [y[-1] for y in sorted(v, key=lambda y: y[:3])] for c, v in conv.items()}
    built = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - c % 20 if c >= 0 else c + -c % 20
        built[c] = tuple(conv.get(first, [])[:h] + turns[h:])
    members, ends, children = {}, {}, {}
    for c, path in built.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(WORD.findall(path[-1][1].encode())) if path else 0
        sums[path] = (sum(sums[p][0] for p in below) or 1, (len(members[path]) - 1) * words + sum(sums[p][1] for p in below))
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *sums[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    ]


def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-45, 120), 1000, 2**40]:
        if c not in (40, 60):  # two branches without their first conversation
            out += [(c, rng.choice([t, t, None, 1]), rng.choice(["u", "a", None]), rng.choice(["", "x y", "a b c", None, "q"])) for t in range(rng.choice([1, 1, 2, 3, 5]))]
    out += [(c, t, "u", "hello there") for c in range(300, 380) for t in range(3)]  # a third are copies
    out += [(500, t, "u", f"{t} deep") for t in range(300)] + [(501, t, "u", f"{t} deep") for t in range(299)]
    out += [(520, 0, "u", "w " * 20_000), (520, 0, "u", "w " * 20_000), (None, 1, "u", "z"), (None, None, None, None)]
    return out


def nodes(spark, found, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in found], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.trie(trie.rebuilt(trie.conversations(df)), **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"ranges": 6, "run_bytes": 3000, "block_rows": 5}, {"ranges": 25, "run_bytes": 300, "block_rows": 1}])
def test_equals_a_dictionary_of_prefixes(spark, more):
    assert nodes(spark, rows(), **more) == sorted(brute(rows()), key=repr)


def test_copies_of_one_conversation_over_many_ranges(spark):
    same = [(c, t, "u", "a b") for c in range(1, 200) for t in range(4)]
    assert nodes(spark, same, ranges=9, run_bytes=500, block_rows=4) == sorted(brute(same), key=repr)


def test_one_turn_each_and_only_turnless(spark):
    # With h of 1 or more a single own turn goes; without a first conversation nothing takes its place.
    single = [(c, 0, "u", str(c)) for c in range(21, 30)]
    assert nodes(spark, single, ranges=4) == sorted(brute(single), key=repr)
    less = [r for r in single if zlib.crc32(str(r[0]).encode()) % 4]
    got = nodes(spark, less, ranges=3)
    assert got == brute(less) and got[0][1] == 0 and got[0][5] == 1


def test_no_conversations(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "u", "x")]) == []


def test_shared_turns():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randrange(40)
        a = os.urandom(DIGEST * n)
        k = rng.randrange(n + 1)
        b = a[: DIGEST * k] + os.urandom(DIGEST * rng.randrange(4))
        want = next((i for i in range(min(len(a), len(b)) // DIGEST) if a[i * DIGEST : (i + 1) * DIGEST] != b[i * DIGEST : (i + 1) * DIGEST]), min(len(a), len(b)) // DIGEST)
        assert shared_turns(a, b) == want == shared_turns(a, b, rng.randrange(want + 1))


def test_the_merge_compares_shared_turns_once():
    rng = random.Random(7)
    paths = sorted((b"".join(bytes([rng.randrange(3)]) * DIGEST for _ in range(rng.randrange(30))), i) for i in range(3000))
    runs = [[] for _ in range(12)]
    for p in paths:
        runs[rng.randrange(12)].append(p)

    def heads(run):
        for before, now in zip([(b"", 0), *run], run, strict=False):
            yield (*now, shared_turns(before[0], now[0]))

    tree = PathTree()
    got = list(Merge(tree, iter(sorted(((r[0], heads(r)) for r in runs), key=lambda x: x[0]))))
    assert [x[:2] for x in got] == paths
    assert [x[2] for x in got[1:]] == [shared_turns(a[0], b[0]) for a, b in zip(paths, paths[1:], strict=False)]
    assert tree.compared < 12 * 16 + len(paths) * 4  # of at most four matches an item most are decided by the numbers alone
    assert tree.compared < 0.75 * 3.6 * len(paths)
