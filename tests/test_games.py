import pytest
from pyspark.sql import functions as F

from cartulary.catalogue import games

FACE = {"role": "front", "name": "A", "mana_cost": None, "type_line": "T", "colours": ["U", "W", "U"], "oracle_text": None, "power": None, "toughness": None}
TRAINER = {"card_type": "trainer", "trainer_type": None, "effect_text": "x", "hp": None, "types": [], "stage": None, "evolves_from": None, "abilities": [], "attacks": [], "weaknesses": [], "resistances": [], "retreat_cost": None, "regulation_mark": None}
LEADER = {"card_type": "leader", "colours": ["red"], "cost": None, "life": 5, "battle_attributes": [], "power": 5000, "counter": None, "traits": [], "block_icons": [], "effect_text": None, "trigger_text": None}


def bad(game, card, entity="card"):
    return games.admit(game, entity, card)[2]


def test_faces_and_layouts():
    card = {"layout": "normal", "type_line": "T", "colour_identity": ["W"], "faces": [FACE]}
    value, warnings, none = games.admit("magic", "card", card)
    assert not none and not warnings and value["faces"][0]["colours"] == ["U", "W"]
    assert bad("magic", card | {"layout": "transform"}) == ["profile_rule:$"]
    assert not bad("magic", card | {"layout": "transform", "faces": [FACE, FACE | {"role": "back"}]})
    for layout in ("art_series", "unknown_layout"):
        assert "unknown_value:$.layout" in bad("magic", card | {"layout": layout})
    assert games.face_roles("unknown_layout", 1) is None
    assert games.face_roles("split", 5) == ["front"] * 5 and games.face_roles("split", 1) is None and games.face_roles("flip", 3) is None


def test_what_applies_to_a_type_of_card():
    assert not bad("pokemon", TRAINER)
    assert bad("pokemon", TRAINER | {"types": ["fire"]}) == ["inapplicable_field:$.types"]
    assert "missing_field:$.trainer_type" in bad("pokemon", {k: v for k, v in TRAINER.items() if k != "trainer_type"})
    energy = {k: v for k, v in TRAINER.items() if k != "trainer_type"} | {"card_type": "energy", "energy_kind": "basic", "provided_energy": {"state": "fixed", "units": ["fire"]}}
    assert not bad("pokemon", energy)
    assert bad("pokemon", energy | {"provided_energy": {"state": "fixed", "units": []}}) == ["wrong_length:$.provided_energy.units"]
    assert bad("pokemon", energy | {"provided_energy": {"state": "unknown", "units": ["fire"]}}) == ["inapplicable_field:$.provided_energy.units"]


def test_rules_of_single_games():
    assert not bad("one-piece", LEADER) and bad("one-piece", LEADER | {"life": None}) == ["profile_rule:$"]
    don = LEADER | {"card_type": "don", "colours": [], "life": None, "power": None}
    assert not bad("one-piece", don) and bad("one-piece", don | {"cost": 1})
    assert bad("one-piece", LEADER | {"card_type": "event"})
    assert bad("gundam", {"alternate_art": "yes"}, "printing") == ["wrong_type:$.alternate_art"]


@pytest.mark.parametrize("game", sorted(games.PROFILES))
def test_every_profile_names_its_missing_fields(game):
    required = {k for k, v in games.PROFILES[game]["card"]["fields"].items() if v["required"]}
    assert {x.split("$.")[1] for x in bad(game, {}) if x.startswith("missing_field")} == required
    assert games.filter_fields(game)


def test_tokens(spark):
    rows = [('{"layout":"token","type_line":"Token Creature"}', None), ('{"layout":"token","type_line":"Creature"}', None), ('{"layout":"normal"}', "art"), ('{"layout":"double_faced_token"}', "gameplay")]
    got = games.classified(spark.createDataFrame(rows, "a string, c string"), "magic", "a", "c").collect()
    assert [(r.c, r.applicability, r.category_conflict) for r in got] == [("token", "applicable", False), ("gameplay", "applicable", False), ("art", "inapplicable", False), ("gameplay", "applicable", True)]
    rift = spark.createDataFrame([('{"supertypes":["token"]}',), ("{}",)], "a string").select(games.is_token("riftbound", F.col("a")).alias("t")).collect()
    assert [r.t for r in rift] == [True, False]
    assert len(games.games()) == 7


def test_roles_as_a_column_are_those_of_the_table(spark):
    rows = [(layout, n) for layout in [*games.LAYOUTS, "unknown", None] for n in range(7)]
    got = spark.createDataFrame(rows, "layout string, n int").select("layout", "n", games.roles_of(F.col("layout"), F.col("n")).alias("r")).collect()
    assert all((None if r.r is None else list(r.r)) == games.face_roles(r.layout, r.n) for r in got) and len(got) == len(rows)
