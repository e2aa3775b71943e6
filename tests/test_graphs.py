import random

import pytest

from cartulary.catalogue import closure, reconcile
from cartulary.operators import graph

REQUEST = "request_id bigint, lineage string, role string, surface string, parent_id bigint, partition string, first bigint, last bigint, locator string, declared bigint, parsed bigint, records bigint"


def reach(spark, roots, edges):
    found = graph.reachable(spark.createDataFrame([(r,) for r in roots], "r bigint"), spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    return {r.node: r["round"] for r in found.collect()}


def test_many_parents_cycles_loops_and_nulls(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 4), (5, 6), (None, 7), (4, None), (4, 9), (1, 2)]
    assert reach(spark, [1, 1, None], edges) == {1: 0, 2: 1, 3: 1, 4: 2, 9: 3}
    assert reach(spark, [42], edges) == {42: 0} and reach(spark, [], edges) == {} and reach(spark, [1], []) == {1: 0}


def test_a_deep_chain_is_followed_to_its_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "COMPACT", 4)
    assert reach(spark, [0], [(i, i + 1) for i in range(21)]) == {i: i for i in range(22)}


def test_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, i) for i in range(30, 50)]
    want, front, n = {0: 0, 7: 0}, {0, 7}, 0
    while front:
        n += 1
        front = {b for a, b in edges if a in front} - want.keys()
        want |= dict.fromkeys(front, n)
    assert reach(spark, [0, 7], edges) == want


def test_retained_objects(spark):
    objects = spark.createDataFrame([(i,) for i in range(6)] + [(None,)], "k bigint")
    context = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "c bigint, p bigint")
    held = [spark.createDataFrame([(x,)], "x bigint") for x in (1, 5)]
    got = {r.k: r.retained for r in reconcile.retained(objects, "k", context, "c", "p", *held).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False, 5: True, None: False}


def faults(spark, ranges, block):
    df = spark.createDataFrame([("g", a, b) for a, b in ranges], "k string, a bigint, b bigint")
    return sorted((r.kind, r["at"]) for r in closure.page_faults(df, ["k"], "a", "b", block).collect())


@pytest.mark.parametrize("block", [1, 4, 10_000])
def test_gaps_and_overlaps_of_pages(spark, block):
    assert faults(spark, [(1, 1), (2, 5), (6, 6), (6, 6)], block) == []
    assert faults(spark, [(1, 2), (5, 9), (7, 7), (10, 10), (30, 31)], block) == [("page_gap", 3), ("page_gap", 11), ("page_overlap", 7)]
    assert faults(spark, [(1, 20), (3, 3), (21, 21), (None, 4)], block) == [("page_overlap", 3)]
    assert faults(spark, [], block) == []


def test_a_closed_graph_has_no_violation_and_each_kind_is_named(spark):
    good = [
        (1, "l", "surface", "cards", None, None, None, None, None, 2, 2, 0),
        (2, "l", "listing", None, 1, "p", 1, 1, None, 2, 2, 2),
        (3, "l", "listing", None, 1, "p", 2, 2, None, 1, 1, 1),
        (4, "l", "detail", None, 2, None, None, None, "a", 1, 1, 1),
        (5, "l", "image", None, 4, None, None, None, None, 0, 0, 0),
    ]
    listed, required = [(2, "l", "a", "x"), (3, "l", "a", "x")], [("l", "cards")]

    def found(requests, listed=listed, required=required):
        r, e, q = spark.createDataFrame(requests, REQUEST), spark.createDataFrame(listed, "request_id bigint, lineage string, locator string, meaning string"), spark.createDataFrame(required, "lineage string, surface string")
        return sorted((x.kind, x.subject) for x in closure.violations(r, e, q).collect())

    assert found(good) == []
    bad = [
        *good,
        (6, "l", "image", None, 99, None, None, None, None, 0, None, 1),
        (7, "l", "detail", None, None, None, None, None, "b", 1, 1, 0),
        (8, "l", "surface", "other", 1, None, None, None, None, 1, 1, 0),
        (9, "l", "listing", None, 1, "p", 4, 5, None, 1, 1, 1),
        (10, "l", "listing", None, 1, "p", 5, 5, None, 1, 1, 1),
    ]
    assert found(bad, [*listed, (9, "l", "a", "y"), (9, "l", "c", "z")], [*required, ("l", "rules")]) == [
        ("count_open", "6"), ("detail_missing", "c"), ("detail_unlisted", "b"), ("detail_without_records", "7"), ("image_with_records", "6"), ("locator_overlap", "a"), ("page_gap", "p#3"),
        ("page_overlap", "p#5"), ("parent_missing", "6"), ("parent_unnamed", "7"), ("root_with_parent", "8"), ("surface_missing", "rules"), ("surface_unexpected", "other"),
    ]
