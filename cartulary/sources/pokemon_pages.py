"""Parser of the publisher's card pages of one game: the card as its page shows it."""

from __future__ import annotations

import re

from cartulary.sources.adapters import Registry, elements, headed_values, only, sole, text_of
from cartulary.sources.cards import _digest, _printing


def _energies(node: dict) -> list[str]:
    return [x["attributes"]["data-energy-type"] for x in elements(node) if x["attributes"].get("data-energy-type")]


def _ability(node: dict) -> tuple[str, dict]:
    heading = next(elements(node, "h3"), None)
    if heading is not None:
        names = [text_of(x) for x in elements(heading, "div")]
        return "abilities", {"kind": names[0] if len(names) > 1 else "Ability", "name": names[-1], "text": text_of(only(node, "p"))}
    text = next((text_of(x) for tag in ("pre", "p") for x in elements(node, tag)), None)
    damage = next((text_of(x) for x in elements(node, "span", class_="right")), None)
    return "attacks", {"name": text_of(sole(node, "h4", class_="label")), "cost": _energies(node), "damage": damage or None, "text": text or None}


def _effects(node: dict) -> list[dict]:
    """Weaknesses or resistances below a heading: an energy and a value for each; none if nothing follows the heading."""
    value = headed_values({"tag": "", "attributes": {}, "children": [node]}, "h4")
    told = next(iter(value.values()), "")
    kinds = [x["attributes"]["title"] for x in elements(node, "i") if x["attributes"].get("title")]
    if bool(told) != bool(kinds):
        raise ValueError("an effect of a type is unclear")
    return [{"type": k, "value": told} for k in kinds]


def card_page(body: str) -> list[dict]:
    """The card of a page: identity, stage, abilities and attacks in order, and what its footer says."""
    page = sole(body, "section", class_="card-detail")
    located = [x["attributes"]["data-card-id"] for x in (page, *elements(page)) if "data-card-id" in x["attributes"]]
    footer = only(page, "div", class_="stats-footer")
    named = [m for x in elements(footer, "span") if (m := re.fullmatch(r"(\S+/\S+) (.+)", text_of(x)))]
    health = re.search(r"\d+", text_of(sole(page, "span", class_="card-hp")))
    if len(set(located)) != 1 or len(named) != 1 or health is None:
        raise ValueError("the card's identity is unclear")
    number, rarity = named[0].groups()
    made: dict[str, list] = {"abilities": [], "attacks": []}
    for x in elements(page, "div", class_="ability"):
        kind, entry = _ability(x)
        if not entry["name"]:
            raise ValueError("an ability without a name")
        made[kind].append(entry)
    sides = {"Weakness": [], "Resistance": []}
    evolves = next((text_of(only(x, "a")) for x in elements(page, "h4") if text_of(x).startswith("Evolves From")), None)
    for x in elements(page):
        headings = [text_of(c) for c in x["children"] if isinstance(c, dict) and c["tag"] == "h4"]
        if len(headings) == 1 and headings[0] in sides:
            sides[headings[0]] = _effects(x)
    hrefs = [x["attributes"].get("href", "") for x in elements(page, "a")]
    types = [x["attributes"]["title"] for a in elements(page, "a") if re.search(r"\?card-\w+=on", a["attributes"].get("href", "")) for x in elements(a, "i") if x["attributes"].get("title")]
    retreat = next((int(m[1]) for h in hrefs if (m := re.search(r"retreatCostMin=(\d+)", h))), None)
    artists = [text_of(a) for a in elements(page, "a") if "particularArtist=" in a["attributes"].get("href", "")]
    stage = text_of(only(page, "h2")).removesuffix("Pokémon").replace(" ", "")
    attributes = {
        "card_type": "pokemon", "hp": int(health[0]), "types": types, "stage": stage or None, "evolves_from": evolves, **made,
        "weaknesses": sides["Weakness"], "resistances": sides["Resistance"], "retreat_cost": retreat, "regulation_mark": None,
    }
    printed = [f"{x['name']}: {x['text']}" for k in made for x in made[k] if x["text"]]
    set_name = text_of(only(only(footer, "h3"), "a"))
    if not types or not set_name:
        raise ValueError("type or set is missing")
    head = {"category": "gameplay", "name": text_of(only(page, "h1")), "rules_text": "\n".join(printed) or None, "attributes": attributes, "design": f"{set_name}:{number}", "review": []}
    printing = {"set_code": set_name, "collector_number": number, "finish": "holo" if "Holo" in rarity.split() else None, "edition": None, "size": None, "stamps": [], "artists": artists, "reverse_face": None}
    row = _printing("pokemon-official", located[0], "base", located[0], rarity, printing)
    row["identity"]["printed_digest"] = _digest([printing, attributes])
    return [{"card": head, **row, "image": only(page, "img")["attributes"]["src"], "memberships": [{"kind": "bucket", "label": set_name}]}]


def register(registry: Registry) -> Registry:
    """Add the parser of this module."""
    registry.register("pokemon-official", "v1", "card")(card_page)
    return registry
