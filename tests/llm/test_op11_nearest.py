import math
import random

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import nearest

SCHEMA = "vec_id bigint, embedding array<double>, rank int, score string"


def brute(rows, k=20):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def answers(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0, **more)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in found.collect())


def awkward():
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -1.0, 2.0]) for _ in range(rng.choice([2, 2, 2, 3, 0]))]) for i in range(-60, 140)]
    rows += [(5, [1.0, 1.0]), (40, [1.0, 1.0]), (40, [1.0, 1.0]), (None, [1.0]), (800, None), (801, [None, 1.0]), (820, [float("nan")]), (840, [float("inf"), 1.0])]
    return rows + [(2000 + i, [0.5, 0.5]) for i in range(100)]  # a vector that a third of the rows have


def test_equals_brute_force_with_ties_copies_and_odd_vectors(spark):
    assert answers(spark, awkward()) == brute(awkward())


def test_many_shards_leaves_and_blocks_of_queries(spark):
    assert answers(spark, awkward(), shard_bytes=4000, leaf_rows=3, block_bytes=400) == brute(awkward())


def test_sums_beyond_doubles_are_exact(spark):
    rows = [(i, [2.0**24 + i / 64, 2.0**-6 * i, -3.0]) for i in range(50)]
    assert answers(spark, rows, k=5) == brute(rows, 5)


def test_limits_of_longs(spark):
    got = answers(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])])
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_few_rows_none_and_no_query(spark):
    assert answers(spark, [(0, [1.0])]) == []
    assert answers(spark, []) == []
    assert answers(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_boxes_are_tight_and_the_search_leaves_points_out():
    rng = np.random.default_rng(2)
    points = rng.integers(-200, 200, (5000, 3))
    tree = nearest.Tree(np.arange(5000), points, 16)
    again = nearest.Tree.read(tree.row())
    for node in range(1, len(tree.begin)):
        own = again.points[tree.begin[node] : tree.end[node]]
        assert (own.min(axis=0) == again.low[node]).all() and (own.max(axis=0) == again.high[node]).all()
    searches = nearest.Searches(np.array([-1, -2]), rng.integers(-200, 200, (2, 3)), 20)
    searches.visit(again)
    assert searches.compared < 2 * 5000 / 4


def test_the_kth_score_is_handed_on():
    rng = np.random.default_rng(3)
    shards = [nearest.Tree(np.arange(2000) + 2000 * i, rng.integers(-200, 200, (2000, 3)), 16) for i in range(4)]
    query = (np.array([-1]), rng.integers(-200, 200, (1, 3)))
    one, apart = nearest.Searches(*query, 20), 0
    for shard in shards:
        one.visit(shard)
        alone = nearest.Searches(*query, 20)
        alone.visit(shard)
        apart += alone.compared
    assert one.compared < apart
    floors = np.array([one.best[0][-1][0]], object)
    with_floor = nearest.Searches(*query, 20, floors)
    for shard in shards:
        with_floor.visit(shard)
    assert with_floor.best == one.best and with_floor.compared <= one.compared
