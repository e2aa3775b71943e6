import json

import pytest

from cartulary.catalogue import admission, carry, curated

SCHEMA = {"kind": "object", "fields": {"name": {"kind": "string", "required": True}, "tags": {"kind": "array", "items": {"kind": "string"}}, "deep": {"kind": "object", "fields": {"x": {"kind": "integer"}}}}}
RECORD = "game string, id string, content string, provenance string"
REVISION = "game string, id string, ordinal int, revision string, path string, value string, reviewed string"


def fields(spark, records, revisions, schema=SCHEMA):
    found = curated.apply_fields(spark.createDataFrame(records, RECORD), spark.createDataFrame(revisions, REVISION), schema).collect()
    return {r.id: (json.loads(r.content), json.loads(r.provenance), r.state, list(r.problems)) for r in found}


def test_paths_in_order_and_back(spark):
    a = {"deep": {"x": 1}, "name": "A", "tags": ["t", "u"]}
    revisions = [
        ("g", "a", 2, "r2", "/name", '"second"', curated.digest("A")), ("g", "a", 1, "r1", "/name", '"first"', curated.digest("A")), ("g", "a", 3, "r3", "/tags/1", '"v"', curated.digest("u")),
        ("g", "a", 4, "r4", "/deep/x", "7", curated.digest(1)),
    ]
    got = fields(spark, [("g", "a", json.dumps(a), None), ("g", "b", '{"name":"B"}', None)], revisions)
    content, provenance, state, bad = got["a"]
    assert (content, state, bad) == ({"deep": {"x": 7}, "name": "second", "tags": ["t", "v"]}, "patched", [])
    assert got["b"] == ({"name": "B"}, [], "official", [])
    # The next run starts from the official record again, and without revisions ends there.
    again = [("g", "a", json.dumps(content), json.dumps(provenance))]
    assert fields(spark, again, revisions)["a"] == got["a"]
    assert fields(spark, again, [])["a"] == (a, [], "official", [])


def test_one_changed_source_blocks_the_whole_game(spark):
    records = [(g, f"{g}{i}", '{"name":"N"}', None) for g in "gh" for i in range(3)]
    revisions = [(g, f"{g}{i}", 1, f"r{g}{i}", "/name", '"M"', curated.digest("N" if (g, i) != ("g", 1) else "other")) for g in "gh" for i in range(2)]
    got = fields(spark, records, revisions)
    assert {k: v[2] for k, v in got.items()} == {"g0": "blocked", "g1": "blocked", "g2": "official", "h0": "patched", "h1": "patched", "h2": "official"}
    assert got["g1"][3] == ["source_changed:rg1"] and got["g0"][0] == {"name": "N"} and got["h0"][0] == {"name": "M"}


@pytest.mark.parametrize(("path", "value", "problem"), [("/name/x", '"v"', "no_such_path:/name/x"), ("/tags/9", '"v"', "no_such_path:/tags/9"), ("/name", "3", "wrong_type:$.name"), ("/deep/x", '"v"', "wrong_type:$.deep.x")])
def test_records_that_the_schema_refuses(spark, path, value, problem):
    got = fields(spark, [("g", "a", '{"name":"A","tags":["t"]}', None)], [("g", "a", 1, "r", path, value, curated.digest("A" if path == "/name" else None))])
    assert got["a"][2] == "blocked" and problem in got["a"][3] and got["a"][0]["name"] == "A"


def test_pointers():
    record = {"a/b": {"~": [1, {"c": 2}]}}
    assert curated.value_at(record, "/a~1b/~0/1/c") == 2 and curated.value_at(record, "/a~1b/~0/7") is None and curated.value_at(record, "/x/y") is None
    assert curated.set_at(record, "/a~1b/~0/0", 5) and curated.set_at(record, "/new/way", 1) and record["new"] == {"way": 1}
    with pytest.raises(ValueError):
        curated.value_at(record, "name")


def test_relationships(spark):
    edges = spark.createDataFrame([("g", "e1", True, None, None), ("g", "e2", False, "present", None), ("g", "e3", True, None, "curated"), ("h", "e4", True, None, None)], "game string, edge_id string, observed boolean, reviewed string, category string")
    revisions = spark.createDataFrame([("g", "e1", "absent", "present"), ("g", "e3", "present", "absent"), ("h", "e4", "absent", "absent")], "game string, edge_id string, asserted string, reviewed string")
    got = {r.edge_id: (r.observed, r.curated, r.conflict) for r in curated.apply_relationships(edges, revisions).collect()}
    assert got == {"e1": (False, True, False), "e2": (True, False, False), "e3": (True, True, False), "e4": (True, False, True)}


def decided(spark, *log):
    df = spark.createDataFrame([("p", i, *x, *(None,) * (4 - len(x))) for i, x in enumerate(log, 1)], "proposal_id string, seq bigint, action string, expected bigint, key string, content string")
    return [(r.outcome, r.generation, r.status) for r in admission.decide(df).orderBy("seq").collect()]


def test_a_decision_counts_only_on_the_generation_that_stands(spark):
    assert decided(spark, ("reject", 0), ("admit", 0), ("reconsider", 1), ("admit", 2), ("link", 3), ("reconsider", 3), ("link", 4)) == [
        ("applied", 1, "rejected"), ("lost_update", 1, "rejected"), ("applied", 2, "unresolved"), ("applied", 3, "admitted"), ("illegal_step", 3, "admitted"), ("applied", 4, "unresolved"), ("applied", 5, "admitted"),
    ]


def test_replays_conflicts_and_content(spark):
    assert decided(spark, ("admit", 0, "k", "new"), ("reject", 0, "k"), ("reject", 0, "k"), ("admit", 1, "k"), ("admit", 1), ("throw", 1), ("admit", None), ("reconsider", 1, "m", "new")) == [
        ("misplaced_content", 0, "unresolved"), ("applied", 1, "rejected"), ("replay", 1, "rejected"), ("conflict", 1, "rejected"), ("illegal_step", 1, "rejected"), ("illegal_step", 1, "rejected"),
        ("lost_update", 1, "rejected"), ("applied", 2, "unresolved"),
    ]


def test_carried_products_and_edges(spark):
    checked = spark.createDataFrame([("g", "A")], "game string, lineage string")
    told = "game string, product_id string, lineage string, name string"
    prior = spark.createDataFrame([("g", "1", "A", "a1"), ("g", "1", "B", "b1"), ("g", "2", "A", "a2"), ("h", "3", "A", "a3")], told)
    observed = spark.createDataFrame([("g", "4", "A", "a4")], told)
    state = spark.createDataFrame([("g", "1", "one"), ("g", "2", "two"), ("h", "3", "three")], "game string, product_id string, name string")
    ranks = spark.createDataFrame([("A", 1), ("B", 2)], "lineage string, rank int")
    got = {r.product_id: (r.name, r.observed, r.lineages, r.missed) for r in carry.products(prior, observed, checked, ranks, state).collect()}
    assert got == {"1": ("b1", False, ["B"], ["A"]), "2": ("two", False, [], ["A"]), "3": ("a3", False, ["A"], None), "4": ("a4", True, ["A"], None)}

    before = spark.createDataFrame([("g", "e1", "A", "x", True, None), ("g", "e2", "A", "x", True, None), ("g", "e3", "B", "x", True, None), ("g", "e4", "A", "x", True, "curated")], "game string, edge_id string, lineage string, label string, observed boolean, category string")
    now = spark.createDataFrame([("g", "e2", "A", "y"), ("g", "e3", "A", "y"), ("g", "e5", "A", "y")], "game string, edge_id string, lineage string, label string")
    got = {r.edge_id: (r.lineage, r.label, r.observed) for r in carry.edges(before, now, checked).collect()}
    assert got == {"e1": ("A", "x", False), "e2": ("A", "y", True), "e3": ("B", "x", True), "e5": ("A", "y", True)}
