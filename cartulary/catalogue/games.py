"""The registered game profiles: schemas of card and printing attributes, tokens, filter fields."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue.profiles import validate

TEXT = {"kind": "string", "min_length": 0}
NAME = {"kind": "string", "min_length": 1}
COUNT = {"kind": "integer", "minimum": 0}
POSITIVE = {"kind": "integer", "minimum": 1}
FLAG = {"kind": "boolean"}
TEXTS = {"kind": "array", "unique": True, "items": {"kind": "string"}}


def one_of(values: list[str]) -> dict:
    return {"kind": "enum", "values": values}


def some_of(values: list[str]) -> dict:
    return {"kind": "array", "unique": True, "items": one_of(values)}


def rows_of(items: dict, **bounds: int) -> dict:
    return {"kind": "array", "items": items, **bounds}


def maybe(shape: dict) -> dict:
    """May be null."""
    return {**shape, "nullable": True}


def optional(shape: dict) -> dict:
    """May be left out."""
    return {**shape, "required": False}


def record(when: dict | None = None, **fields: dict) -> dict:
    return {"kind": "object", "fields": {k: {"required": True, **v} for k, v in fields.items()}} | ({"when": when} if when else {})


# The vocabularies of the games, and the fields of their cards and printings.
COLOURS = ["red", "green", "blue", "purple", "black", "yellow", "white", "colourless"]
MANA = ["W", "U", "B", "R", "G"]
ROLES = ["front", "back"]
#: Layout: the least and the most faces, and whether the second one is on the back.
LAYOUTS = {
    "normal": (1, 1, False),
    "token": (1, 1, False),
    "art_series": (2, 2, True),
    "transform": (2, 2, True),
    "saga": (1, 1, False),
    "adventure": (2, 2, False),
    "planar": (1, 1, False),
    "split": (2, 5, False),
    "modal_dfc": (2, 2, True),
    "emblem": (1, 1, False),
    "double_faced_token": (2, 2, True),
    "scheme": (1, 1, False),
    "mutate": (1, 1, False),
    "prepare": (2, 2, False),
    "class": (1, 1, False),
    "meld": (1, 1, False),
    "leveler": (1, 1, False),
    "flip": (2, 2, False),
    "prototype": (1, 1, False),
    "vanguard": (1, 1, False),
    "host": (1, 1, False),
    "case": (1, 1, False),
    "augment": (1, 1, False),
    "reversible_card": (2, 2, True),
}

MAGIC_FACE = record(
    role=one_of(ROLES), name=NAME, mana_cost=maybe(TEXT), type_line=maybe(NAME), colours=maybe(some_of(MANA)),
    oracle_text=maybe(TEXT), power=maybe(TEXT), toughness=maybe(TEXT),
)
MAGIC_CARD = record(layout=one_of([x for x in LAYOUTS if x != "art_series"]), type_line=NAME, colour_identity=some_of(MANA), faces=rows_of(MAGIC_FACE, min_items=1, max_items=5))
MAGIC_PRINTED_FACE = record(role=one_of(ROLES), name=NAME, printed_rules_text=maybe(TEXT))
MAGIC_PRINTING = record(
    set_code=NAME, collector_number=NAME, finish=one_of(["nonfoil", "foil", "etched"]), layout=one_of(list(LAYOUTS)),
    faces=rows_of(MAGIC_PRINTED_FACE, min_items=1, max_items=5), artists=TEXTS, reverse_face=maybe(TEXT), finish_image=maybe(TEXT),
)

NO_CREATURE = {"types": [], "stage": None, "evolves_from": None, "abilities": [], "attacks": [], "weaknesses": [], "resistances": [], "retreat_cost": None}
#: What applies to each type of card.
POKEMON_CASES = {
    "field": "card_type",
    "cases": {
        "pokemon": {"absent": ["trainer_type", "effect_text", "energy_kind", "provided_energy"]},
        "trainer": {"required": ["trainer_type", "effect_text"], "absent": ["energy_kind", "provided_energy"], "empty": NO_CREATURE},
        "energy": {"required": ["energy_kind", "provided_energy", "effect_text"], "absent": ["trainer_type"], "empty": {"hp": None, **NO_CREATURE}},
    },
}
ENERGY_CASES = {"field": "state", "cases": {"fixed": {"least": {"units": 1}}, "unknown": {"empty": {"units": []}}}}
POKEMON_EFFECT = record(type=NAME, value=NAME)
POKEMON_CARD = record(
    when=POKEMON_CASES,
    card_type=one_of(["pokemon", "trainer", "energy"]), trainer_type=optional(maybe(TEXT)), effect_text=optional(maybe(TEXT)),
    energy_kind=optional(one_of(["basic", "special", "unknown"])),
    provided_energy=optional(record(when=ENERGY_CASES, state=one_of(["fixed", "unknown"]), units=rows_of(NAME))),
    hp=maybe(COUNT), types=TEXTS, stage=maybe(TEXT), evolves_from=maybe(TEXT),
    abilities=rows_of(record(kind=maybe(TEXT), name=NAME, text=maybe(TEXT))),
    attacks=rows_of(record(name=NAME, cost=rows_of(TEXT), damage=maybe(TEXT), text=maybe(TEXT))),
    weaknesses=rows_of(POKEMON_EFFECT), resistances=rows_of(POKEMON_EFFECT), retreat_cost=maybe(COUNT), regulation_mark=maybe(TEXT),
)
POKEMON_PRINTING = record(set_code=NAME, collector_number=NAME, finish=maybe(TEXT), edition=maybe(TEXT), size=maybe(TEXT), stamps=TEXTS, artists=TEXTS, reverse_face=maybe(TEXT))

RIFTBOUND_CARD = record(
    card_types=some_of(["spell", "battlefield", "unit", "gear", "legend", "rune"]), supertypes=some_of(["champion", "signature", "token"]),
    domains=some_of(["fury", "calm", "mind", "body", "chaos", "order", "colorless"]),
    energy=maybe(COUNT), power=maybe(COUNT), might=maybe(COUNT), might_bonus=maybe(COUNT), tags=TEXTS, ability_text=maybe(TEXT), effect_text=maybe(TEXT),
)
RIFTBOUND_PRINTING = record(public_code=maybe(TEXT), collector_number=maybe(COUNT), set_code=NAME, orientation=maybe(TEXT), reverse_face=maybe(TEXT), finish=maybe(TEXT), artists=TEXTS)

ONE_PIECE_CARD = record(
    card_type=one_of(["leader", "character", "event", "stage", "don"]), colours=some_of(COLOURS), cost=maybe(COUNT), life=maybe(COUNT), battle_attributes=TEXTS,
    power=maybe(COUNT), counter=maybe(COUNT), traits=TEXTS, block_icons=TEXTS, effect_text=maybe(TEXT), trigger_text=maybe(TEXT),
)
ONE_PIECE_PRINTING = record(illustration_types=optional(some_of(["comic", "animation", "original", "other"])))

FUSION_WORLD_LEADER = record(role=one_of(ROLES), name=NAME, power=optional(maybe(COUNT)), traits=TEXTS, skills=TEXT)
FUSION_WORLD_CARD = record(
    card_type=one_of(["leader", "battle", "extra", "energy_marker"]), colours=some_of(COLOURS), cost=maybe(COUNT),
    specified_cost=rows_of(record(colour=one_of(["red", "blue", "green", "yellow", "black"]), count=POSITIVE)), power=maybe(COUNT), combo_power=maybe(COUNT), traits=TEXTS,
    skills=rows_of(record(kind=one_of(["ordinary", "front", "back"]), text=TEXT)),
    leader_faces=optional(rows_of(FUSION_WORLD_LEADER, min_items=2, max_items=2)),
)

DIGIMON_SECTIONS = ["effect", "inherited_effect", "security_effect", "rule", "special_digivolution_condition", "dual_effect", "dual_rule", "link_condition", "link_effect"]
DIGIMON_EVOLUTION = record(index=optional(POSITIVE), from_level=optional(maybe(COUNT)), colours=optional(some_of(COLOURS)), cost=COUNT, raw_condition=optional(maybe(TEXT)))
DIGIMON_CARD = record(
    card_type=one_of(["digi_egg", "digimon", "tamer", "option", "digimon_option"]), colours=some_of(COLOURS), level=maybe(COUNT), play_cost=maybe(COUNT), use_cost=maybe(COUNT),
    dp=maybe(COUNT), form=maybe(TEXT), attribute=maybe(TEXT), traits=TEXTS, digivolution_requirements=rows_of(DIGIMON_EVOLUTION),
    text_sections=rows_of(record(kind=one_of(DIGIMON_SECTIONS), text=TEXT)), dual_colours=optional(some_of(COLOURS)), dual_cost=optional(maybe(COUNT)), link_dp=optional(maybe(COUNT)),
)

GUNDAM_CARD = record(
    card_type=one_of(["unit", "pilot", "command", "base", "resource", "ex_base", "ex_resource", "unit_token"]), colours=some_of(COLOURS), level=maybe(COUNT), cost=maybe(COUNT),
    block_icon=maybe(TEXT), effect_text=maybe(TEXT), zone=maybe(TEXT), traits=TEXTS, link_condition=maybe(TEXT), ap=maybe(COUNT), hp=maybe(COUNT), series_titles=TEXTS,
)

PROFILES: dict[str, dict] = {
    "magic": {"id": "magic@1", "card": MAGIC_CARD, "printing": MAGIC_PRINTING},
    "pokemon": {"id": "pokemon@1", "card": POKEMON_CARD, "printing": POKEMON_PRINTING},
    "riftbound": {"id": "riftbound@1", "card": RIFTBOUND_CARD, "printing": RIFTBOUND_PRINTING},
    "one-piece": {"id": "one-piece@1", "card": ONE_PIECE_CARD, "printing": ONE_PIECE_PRINTING},
    "fusion-world": {"id": "fusion-world@1", "card": FUSION_WORLD_CARD, "printing": record()},
    "digimon": {"id": "digimon@1", "card": DIGIMON_CARD, "printing": record(alternative_art=FLAG)},
    "gundam": {"id": "gundam@1", "card": GUNDAM_CARD, "printing": record(alternate_art=FLAG)},
}


def face_roles(layout: str, n: int) -> list[str] | None:
    """The roles of n faces of a layout, None if it can't have so many or is not known."""
    least, most, turned = LAYOUTS.get(layout, (0, -1, False))
    if not least <= n <= most:
        return None
    return ROLES if turned else ["front"] * n


def roles_of(layout: Column, n: Column) -> Column:
    """face_roles of a layout and a number of faces, as a column: null if they don't fit or the layout is not known."""
    table = F.create_map(*[x for name, (least, most, turned) in LAYOUTS.items() for x in (F.lit(name), F.struct(F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(turned).alias("turned")))])
    at = F.try_element_at(table, layout)
    sides = F.when(at["turned"], F.array(*map(F.lit, ROLES))).otherwise(F.array_repeat(F.lit("front"), n.cast("int")))
    return F.when((n >= at["least"]) & (n <= at["most"]), sides)


def _magic(card: dict) -> bool:
    return [f.get("role") for f in card.get("faces", [])] == face_roles(card.get("layout", ""), len(card.get("faces", [])))


def _riftbound(card: dict) -> bool:
    return bool(card.get("card_types")) or "token" in card.get("supertypes", [])


def _one_piece(card: dict) -> bool:
    kind = card.get("card_type")
    if kind == "leader":
        return card.get("life") is not None
    if kind in ("character", "event", "stage"):
        return card.get("cost") is not None
    return kind != "don" or (card.get("colours") == [] and all(card.get(k) is None for k in ("cost", "life", "power", "counter")))


def _fusion_world(card: dict) -> bool:
    return card.get("card_type") != "leader" or sorted(f.get("role", "") for f in card.get("leader_faces", [])) == ["back", "front"]


HOOKS: dict[str, Callable[[dict], bool]] = {"magic": _magic, "riftbound": _riftbound, "one-piece": _one_piece, "fusion-world": _fusion_world}


def admit(game: str, entity: str, attributes: Any) -> tuple[Any, list[str], list[str]]:
    """Attributes as the game's profile admits them, warnings, diagnostics; entity is card or printing."""
    value, warnings, bad = validate(attributes, PROFILES[game][entity])
    if entity == "card" and not bad and game in HOOKS and not HOOKS[game](value):
        bad.append("profile_rule:$")
    return value, warnings, bad


def is_token(game: str, attributes: Column) -> Column:
    """Whether the JSON attributes make a token card."""
    at = lambda k: F.coalesce(F.get_json_object(attributes, f"$.{k}"), F.lit(""))
    if game == "magic":
        return (at("layout") == "double_faced_token") | ((at("layout") == "token") & at("type_line").rlike(r"^Token(?: |$)"))
    if game == "gundam":
        return at("card_type") == "unit_token"
    if game == "riftbound":
        return F.coalesce(F.array_contains(F.from_json(at("supertypes"), "array<string>"), "token"), F.lit(False))
    return F.lit(False)


def classified(cards: DataFrame, game: str, attributes: str, category: str) -> DataFrame:
    """cards with category filled in and applicability; one that conflicts with its profile has conflict set."""
    token = is_token(game, F.col(attributes))
    own = F.coalesce(F.col(category), F.when(token, "token").otherwise("gameplay"))
    conflict = ~own.isin("gameplay", "token", "art") | ((own == "token") != token)
    return cards.withColumns({category: own, "applicability": F.when(own == "art", "inapplicable").otherwise("applicable"), "category_conflict": conflict})


def filter_fields(game: str) -> list[tuple[str, str]]:
    """The scalar leaves of a game's cards that filters may name, with their kind."""

    def walk(s: dict, path: str) -> list[tuple[str, str]]:
        if s["kind"] == "object":
            return [x for k, v in s["fields"].items() for x in walk(v, f"{path}.{k}" if path else k)]
        return walk(s["items"], path) if s["kind"] == "array" else [(path, s["kind"])]

    return walk(PROFILES[game]["card"], "")


def games() -> list[dict]:
    """Supported games with their profile and filter fields."""
    return [{"game": g, "profile": p["id"], "filters": [re.sub(r"^\.", "", k) for k, _ in filter_fields(g)]} for g, p in PROFILES.items()]
