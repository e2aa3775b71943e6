import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartulary.llm import common, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(pairs):
    """(doc_id, fp) to the smallest doc_id reachable, by brute force."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (a, x) in enumerate(pairs):
        for j, (b, y) in enumerate(pairs[:i]):
            if (x ^ y).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(pairs):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted([(a, x, least.get(find(i))) for i, (a, x) in enumerate(pairs)], key=repr)


def test_fingerprint_is_sparks_hash(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.array([simhash.fingerprint(b"a b c")], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 3])
def test_documents_against_brute_force(messy, limit):
    docs = [(r.doc_id, fingerprint(r.text)) for r in messy.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(messy, cell_limit=limit).collect()
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=repr) == component_of(docs)


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 20, 4])
def test_clusters_of_fingerprints(spark, limit):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    pairs = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for _, x in pairs], "fp bigint")
    roots = {r.node % (1 << 64): r.root for r in common.components(simhash.links(df, limit)).collect()}
    groups: dict[int, list[int]] = {}
    for i, x in pairs:
        groups.setdefault(roots.get(x, ('own', x)), []).append(i)
    assert sorted([(i, x, min(groups[roots.get(x, ('own', x))])) for i, x in pairs], key=repr) == component_of(pairs)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (300, None)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 200)}
    assert common.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_pairs_of_a_cell_are_not_emitted(spark):
    """A tight cluster yields fewer links than a multiple of its size."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)})
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    assert simhash.links(df).agg(F.count("*")).first()[0] < 34 * len(fps)
