import pytest

from cartulary.catalogue import corrections

DECISION = "sequence bigint, action string, kind string, game string, sources array<string>, targets array<string>, assignments map<string,string>"
CARDS = [(f"c{i}", "g" if i < 8 else "h", "art" if i == 7 else "gameplay") for i in range(10)]
PRINTINGS = [("p0", "c0"), ("p1", "c1"), ("p2", "c1"), ("p3", "c2"), ("p4", "c2"), ("p9", "c9")]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(CARDS, "id string, game string, category string"), spark.createDataFrame(PRINTINGS, "id string, card_id string")


def rows(spark, *decisions):
    return spark.createDataFrame([(*d, *({},) * (7 - len(d))) for d in decisions], DECISION)


def problems(spark, base, *decisions, history=()):
    found = corrections.problems(rows(spark, *decisions), rows(spark, *history), *base).collect()
    return sorted((r.sequence, r.code, r.subject) for r in found)


def test_faultless_decisions(spark, base):
    split = (2, "split", "card", "g", ["c1"], ["c4", "c5"], {"p1": "c4", "p2": "c5"})
    assert problems(spark, base, (1, "merge", "card", "g", ["c0", "c3"], ["c6"]), split, (3, "merge", "printing", "g", ["p3"], ["p4"])) == []
    assert problems(spark, base, (9, "assign", "card", "g", ["c1"], ["c5"], {"p1": "c5"}), history=[split]) == []


def test_each_fault_is_named(spark, base):
    got = problems(
        spark, base,
        (1, "merge", "card", "g", ["c0"], ["c1", "c2"]), (2, "split", "card", "g", ["c1"], ["c1", "c2"]), (3, "merge", "card", "g", ["c0", "c0"], ["c2"]), (4, "throw", "card", "g", ["c0"], ["c2"]),
        (5, "merge", "card", "g", ["c9"], ["c3"]), (6, "merge", "card", "g", ["x"], ["c3"]), (7, "merge", "card", "g", ["c4"], ["c7"]), (8, "merge", "printing", "g", ["p0"], ["p1"]),
        (10, "split", "card", "g", ["c2"], ["c5", "c6"], {"p3": "c0", "p1": "c5"}), (11, "merge", "card", "g", ["c6"], ["c2"]), (12, "assign", "card", "g", ["c3"], ["c5"], {"p1": "c5"}), (13, "merge", "card", "g", ["c5"], ["c6"], {"p1": "c6"}),
    )
    assert got == sorted([
        (1, "malformed", "merge"), (2, "malformed", "split"), (3, "malformed", "merge"), (4, "malformed", "throw"), (5, "other_game", "c9"), (6, "unknown_entity", "x"), (7, "category_differs", "art"),
        (8, "printings_of_several_cards", "c0"), (10, "assigned_elsewhere", "p3"), (10, "foreign_assignment", "p1"), (10, "printing_unassigned", "p4"), (11, "retired_before", "c2"),
        (12, "no_split", "c3"), (13, "needless_assignment", "p1"), (13, "retired_before", "c6"),
    ])


def test_retired_ids_of_the_history_are_not_chosen_again(spark, base):
    assert problems(spark, base, (5, "merge", "card", "g", ["c3"], ["c0"]), history=[(1, "merge", "card", "g", ["c0"], ["c6"])]) == [(5, "retired_before", "c0")]


def applied(spark, base, *decisions, images=(), edges=()):
    got = corrections.apply(rows(spark, *decisions), *base, spark.createDataFrame(list(images), "id string, printing_id string"), spark.createDataFrame(list(edges), "id string, from_kind string, from_id string, to_kind string, to_id string"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_chains_assignments_and_the_cascade(spark, base):
    got = applied(
        spark, base,
        (1, "split", "card", "g", ["c1"], ["c4", "c5"], {"p1": "c4"}), (2, "merge", "card", "g", ["c4"], ["c6"]), (3, "assign", "card", "g", ["c1"], ["c5"], {"p1": "c5"}),
        (4, "merge", "card", "g", ["c2"], ["c4"]), (5, "merge", "printing", "g", ["p3"], ["p4"]), (6, "merge", "card", "g", ["c3"], ["gone"]),
        images=[("i1", "p1"), ("i2", "p2"), ("i3", "p3"), ("i4", "p4")], edges=[("e1", "card", "c1", "product", "x"), ("e2", "printing", "p2", "card", "c0"), ("e3", "product", "x", "printing", "p0"), ("e4", "card", "c4", "card", "c1")],
    )
    assert got == sorted([
        ("card", "c1", "retired", "c4,c5"), ("card", "c2", "retired", "c4"), ("card", "c3", "retired", "gone"), ("card", "c4", "retired", "c6"), ("printing", "p3", "retired", "p4"),
        ("printing", "p1", "moved", "c5"), ("printing", "p2", "excluded", None), ("printing", "p4", "moved", "c6"),
        ("image", "i2", "dropped", None), ("image", "i3", "dropped", None), ("edge", "e1", "dropped", None), ("edge", "e2", "dropped", None), ("edge", "e4", "dropped", None), ("card", "c3", "dangling", "gone"),
    ], key=repr)


def test_cycles_fail_and_nothing_to_do_does_nothing(spark, base):
    with pytest.raises(ValueError, match="cycle"):
        corrections.moved_printings(rows(spark, (1, "merge", "card", "g", ["c0"], ["c1"]), (2, "merge", "card", "g", ["c1"], ["c0"])), base[1]).collect()
    assert applied(spark, base) == []
