import pytest

from cartulary.catalogue import errata, selection
from cartulary.operators import identity, publish


def lines(spark, heads, parents):
    found = identity.line(spark.createDataFrame([(h,) for h in heads], "h bigint"), spark.createDataFrame(parents, "c bigint, p bigint"), "c", "p").collect()
    return {(r.head, r.node): r.distance for r in found}


def test_lines_of_predecessors(spark):
    assert lines(spark, [20, 7], [(i, i - 1) for i in range(1, 21)]) == {**{(20, n): 20 - n for n in range(21)}, **{(7, n): 7 - n for n in range(8)}}
    assert lines(spark, [3, 9, None], [(3, 1), (4, 1), (1, None)]) == {(3, 3): 0, (3, 1): 1, (9, 9): 0} and lines(spark, [], []) == {}
    with pytest.raises(ValueError, match="cycle"):
        lines(spark, [1], [(1, 2), (2, 3), (3, 2)])


DECISION, PLAN = "game string, area string, locale string, region string, lineage string, sequence int", "lineage string, participation string, game string, locale string, region string, areas array<string>"


def test_missing_authorities(spark):
    decisions = spark.createDataFrame([("g", "catalogue", "en", "eu", "old", 1), ("g", "catalogue", "en", "eu", "own", 2), ("g", "errata", "en", "eu", "far", 1), ("h", "catalogue", "en", "eu", "none", 1)], DECISION)
    plans = spark.createDataFrame([("old", "required", "g", "en", "eu", ["catalogue", "errata"]), ("far", "required", "g", "de", "eu", ["errata"])], PLAN)
    got = sorted((r.area, r.lineage, r.applicable) for r in selection.missing_authorities(decisions, plans).collect())
    assert got == [("catalogue", "own", ["old"]), ("errata", "far", ["old"])]


def test_outages_failures_and_authorities(spark):
    plans = spark.createDataFrame([(n, p, "g", "en", "eu", ["catalogue"]) for n, p in (("a", "required"), ("b", "optional"), ("c", "optional"), ("d", "required"), ("e", "optional"))], PLAN)
    requests = spark.createDataFrame([("a", "detail", "done", None), ("a", "image", "failed", "gone"), ("b", "detail", "failed", "timeout"), ("c", "detail", "failed", "timeout"), ("c", "detail", "failed", "bad_shape"), ("d", "detail", "failed", "unavailable"), ("e", "detail", "done", None)], "lineage string, role string, state string, code string")
    decisions = spark.createDataFrame([("g", "catalogue", "en", "eu", "b", 1)], DECISION)

    def outcome(unchanged):
        found = selection.selected_sources(requests, plans, decisions, spark.createDataFrame(unchanged, "lineage string, unchanged boolean")).collect()
        return {r.subject: r.outcome for r in found}

    assert outcome([]) == {"a": "collected", "b": "omitted", "c": "blocked", "d": "blocked", "e": "collected", "g/catalogue/en/eu/b": "missing"}
    assert outcome([("a", True), ("d", True), ("e", True)])["g/catalogue/en/eu/b"] == "unchanged"
    assert outcome([("a", True), ("d", False), ("e", True)])["g/catalogue/en/eu/b"] == "missing"


def test_errata_name_one_target(spark):
    parsed = spark.createDataFrame(
        [(1, "l", "g", "card", "A", None, None, "w", "v"), (2, "l", "g", "card", "B", None, None, "w", "v"), (3, "l", "g", "card", "none", "n1", None, "w", "v"), (4, "l", "g", "printing", "A", None, None, "w", "v"), (5, "l", "h", "card", "A", None, None, "w", "v"), (6, "l", "g", "printing", "zz", None, None, "w", "v"), (7, "m", "g", "card", "A", None, None, "w", "v")],
        "observation_id int, lineage string, game string, target_type string, name string, number string, effective_from string, wording string, value string",
    )
    cards = spark.createDataFrame([("c1", "g", "A", "n1"), ("c2", "g", "B", None), ("c3", "g", "B", "n3")], "card_id string, game string, name string, number string")
    got = {r.observation_id: r for r in errata.identified(parsed, cards, spark.createDataFrame([(6, "p6")], "observation_id int, printing_id string")).collect()}
    assert {k: (r.target_id, r.problem) for k, r in got.items()} == {1: ("c1", None), 2: (None, "ambiguous_target"), 3: ("c1", None), 4: (None, "printing_not_accepted"), 5: (None, "unknown_target"), 6: ("p6", None), 7: ("c1", None)}
    assert got[1].erratum_id == got[7].erratum_id == got[3].erratum_id != got[6].erratum_id and got[2].erratum_id is None
    told = "erratum_id string, target_id string, effective_from string, wording string, value string, lineage string"
    carried, now = spark.createDataFrame([("e1", "c1", None, "w", "v", "a"), ("e2", "c1", None, "w", "v", "a")], told), spark.createDataFrame([("e1", "c1", None, "w", "v", "b"), ("e2", "c1", None, "w", "x", "a"), ("e3", "c2", None, "w", "v", "b")], told)
    assert {r.erratum_id: (r.lineages, r.conflict) for r in errata.merged(carried, now).collect()} == {"e1": (["a", "b"], False), "e2": (["a"], True), "e3": (["b"], False)}


def test_histories_end_return_and_go_missing(spark):
    history = spark.createDataFrame([], "k string, fact string, first_revision bigint, last_revision bigint, current boolean, missing boolean")
    for revision, now in enumerate([["x"], ["x", "y"], ["y"], [], [], ["x"]], 1):
        history = publish.extend_history(history, spark.createDataFrame([("e", f) for f in now] + [("e", None)], "k string, fact string"), ["k"], "fact", revision)
    got = sorted((r.fact or "-", r.first_revision, r.last_revision, r.current, r.missing) for r in history.collect())
    assert got == [("-", 4, 5, False, True), ("x", 1, 2, False, False), ("x", 6, 6, True, False), ("y", 2, 3, False, False)]


def test_unchanged_by_the_nearest_accepted_evidence(spark):
    candidates = spark.createDataFrame([(3, "g", 2), (2, "g", 1), (1, "g", None)], "id int, game string, predecessor int")
    heads = spark.createDataFrame([(3,)], "id int")
    told = "candidate int, lineage string, adapter string, request_id string, role string, digest string"
    selections = spark.createDataFrame([(1, "a", "v", "r", "detail", "d"), (2, "a", "v", "r", "detail", "e"), (1, "b", "v", "r", "detail", "d"), (3, "b", "v", "r", "detail", "no"), (1, "c", "v", "r", "detail", "d"), (1, "c", "v", "s", "detail", "d"), (1, "d", "v", "i", "image", "d")], told)
    now = spark.createDataFrame([("g", n, "v", "r", "detail", "d") for n in "abcde"] + [("g", "b", "v", "i", "image", "zz")], "game string, lineage string, adapter string, request_id string, role string, digest string")
    got = {r.lineage: (r.accepted_in, r.n_accepted, r.unchanged) for r in selection.unchanged_lineages(candidates, heads, selections, now).collect()}
    assert got == {"a": (2, 1, False), "b": (1, 1, True), "c": (1, 2, False), "d": (None, 0, False), "e": (None, 0, False)}
