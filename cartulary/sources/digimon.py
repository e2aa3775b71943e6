"""Parser of the publisher's card lists of one game: cards in pop-ups, with the questions asked about them."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from cartulary.sources.adapters import Registry, elements, headed_values, label_values, only, query_of, sole, text_of, without
from cartulary.sources.cards import _digest, _listed, _number, _printing

# The publisher's card numbers, types, fields and colours.
NUMBER = r"[A-Z]{1,6}[0-9]{0,3}-[0-9]{1,5}"
TYPES = {"digi-egg": "digi_egg", "digimon": "digimon", "tamer": "tamer", "option": "option", "digimon/option": "digimon_option"}
TITLES = ("cardNo", "cardRarity", "cardType", "cardLv", "cardParallel")
COLOURS = ("red", "blue", "green", "yellow", "black", "purple", "white")
SECTIONS = {
    "Effect": "effect",
    "Inherited Effect": "inherited_effect",
    "Security Effect": "security_effect",
    "Special Digivolution Condition": "special_digivolution_condition",
    "DUAL Effect": "dual_effect",
    "DUAL Rule": "dual_rule",
    "Link Condition": "link_condition",
    "Link Effect": "link_effect",
}
FIELDS = ("Color", "Cost", "Play Cost", "Use Cost", "DP", "Form", "Attribute", "Type", "DUAL Color", "DUAL Cost", "Link DP", "Notes")
NO_LEVEL = ("", "n/a", "not available", "unavailable")


def card_type(raw: str) -> str:
    return TYPES["".join(raw.split()).lower()]


def _dashed(raw: str | None) -> str | None:
    return None if raw is None or not raw.strip("-‐‑–— ") else raw


def _level(raw: str | None) -> int | None:
    if raw is None or (_dashed(raw) or "").lower() in NO_LEVEL:
        return None
    return _number(raw.removeprefix("Lv."))


def _evolution(index: int, raw: str) -> dict:
    """What a card develops from: colours, cost, and a level or a grade in words (then from_level is null)."""
    colours, cost, source = re.fullmatch(r"(.+?)\s+(\d+)\s+from\s+(.+)", raw).groups() if " from " in raw else ("", "", "")
    named = [] if colours == "Multicolor" else [c.lower() for c in re.split(r"[\s/]+", colours)]
    if not cost or not set(named) <= set(COLOURS):
        raise ValueError(f"no requirement: {raw}")
    level = re.fullmatch(r"Lv\.?(\d+)", source)
    return {"index": index, "from_level": int(level[1]) if level else None, "colours": sorted(set(named)), "cost": int(cost), "raw_condition": raw}


def _question(node: dict) -> dict:
    answer = sole(node, "dd", class_="cardFaqAnswer")
    related = []
    for box in elements(answer, class_="relatedBox"):
        for a in elements(box, "a"):
            number = unquote(query_of(a["attributes"].get("href", ""))["free"]).strip("　 ")
            if not re.fullmatch(NUMBER, number) or only(a, "img")["attributes"].get("alt", "").strip("　 ") != number:
                raise ValueError("a related card's identity is unclear")
            related.append(number)
        if not related:
            raise ValueError("related cards are missing")
    dated = [text_of(x) for x in elements(node, class_="cardFaqDate")]
    said = {"number": text_of(sole(node, class_="cardFaqNum")), "question": text_of(sole(node, "dt", class_="cardFaqQuestion")), "answer": text_of(without(answer, "relatedBox"))}
    if len(dated) > 1 or not all(said.values()):
        raise ValueError("a question is incomplete")
    return {**said, "date": dated[0] if dated else None, "related_cards": related}


def _card(box: dict, listed_type: str | None) -> dict:
    popup = sole(box, class_="popupCol")
    locator = popup["attributes"].get("id", "")
    read = re.fullmatch(rf"({NUMBER})(?:_P(\d+))?", locator)
    if read is None or sole(box, "a", class_="card_img")["attributes"].get("data-src") != f"#{locator}":
        raise ValueError("a card's locator is unclear")
    titles: dict[str, str] = {}
    for x in elements(sole(popup, "ul", class_="cardTitleList"), "li"):
        name = x["attributes"].get("class", "").strip()
        if name not in TITLES or name in titles:
            raise ValueError(f"title field {name}")
        titles[name] = text_of(x)
    number, kind = titles["cardNo"], card_type(titles["cardType"])
    alternative = read[2] is not None
    if number != read[1] or titles.get("cardParallel") != ("Alternative Art" if alternative else None):
        raise ValueError("the locator and the card disagree")
    if listed_type not in (None, kind):
        raise ValueError("a card of another type than the list's")
    info = sole(popup, class_="cardInfoCol")
    asked = list(elements(info, "ul", class_="cardFaqList"))
    questions = [_question(q) for x in asked for q in elements(x, "li", class_="cardFaqListItem")]
    if len(asked) > 1 or (asked and not questions):
        raise ValueError("the questions are incomplete")
    info = without(info, "cardFaqList")
    fields = {k.rstrip(":").strip("[]"): v for k, v in {**headed_values(info), **label_values(info)}.items()}
    steps = sorted(((int(k.rsplit(" ", 1)[1]), v) for k, v in fields.items() if re.fullmatch(r"Digivolve Cost \d+", k)))
    rules, power = fields.get("Effect", ""), fields.get("Link DP")
    attributes = {
        "card_type": kind, "colours": [c.lower() for c in _listed(fields.get("Color"))], "level": _level(titles.get("cardLv")),
        "play_cost": _number(fields.get("Play Cost", fields.get("Cost"))), "use_cost": _number(fields.get("Use Cost")), "dp": _number(fields.get("DP")),
        "form": _dashed(fields.get("Form")), "attribute": _dashed(fields.get("Attribute")), "traits": _listed(fields.get("Type")),
        "digivolution_requirements": [_evolution(i, v) for i, (_, v) in enumerate(steps, 1)],
        "text_sections": [{"kind": SECTIONS[k], "text": v} for k, v in fields.items() if k in SECTIONS and _dashed(v)],
        "dual_colours": [c.lower() for c in _listed(fields.get("DUAL Color"))], "dual_cost": _number(fields.get("DUAL Cost")),
        "link_dp": _number(power.removeprefix("DP+") if power else None),
    }
    image = only(sole(popup, class_="cardImgInner"), "img")["attributes"]
    head = {"category": "gameplay", "name": text_of(sole(popup, class_="cardTitle")), "rules_text": rules or None, "attributes": attributes, "design": number, "review": []}
    if not head["name"] or not titles.get("cardRarity"):
        raise ValueError("name or rarity is missing")
    made = _printing("digimon", locator, f"alternate-art-{int(read[2])}" if alternative else "base", locator, titles["cardRarity"], {"alternative_art": alternative})
    made["identity"]["printed_digest"] = _digest([number, titles, fields])
    other = {k: v for k, v in fields.items() if k not in FIELDS and k not in SECTIONS and not k.startswith("Digivolve Cost ")}
    return {
        "card": head, **made, "image": image.get("data-src") or image.get("src"), "questions": questions, "other_fields": other,
        "memberships": [{"kind": "context", "label": fields.get("Notes")}],
    }


def card_list(listed_type: str | None = None) -> Callable[[str], list[dict]]:
    """A parser of a list's page: every record of it, on pages numbered from 1; with listed_type all of that type."""

    def parse(body: str) -> list[dict]:
        boxes = [x for x in elements(body, "li", class_="image_lists_item") if "data" in x["attributes"]["class"].split()]
        if not 1 <= sum(1 for _ in elements(body, class_="paging")) <= 2 or sum(1 for _ in elements(body, class_="popupCol")) != len(boxes):
            raise ValueError("the list is incomplete")
        pages = {int(p[1]) if (p := re.search(r"\bpage-(\d+)\b", x["attributes"]["class"])) else 0 for x in boxes}
        if pages != set(range(1, len(pages) + 1)):
            raise ValueError("the pages have a gap")
        return [_card(x, listed_type) for x in boxes]

    return parse


def card_list_of(body: str, url: str) -> list[dict]:
    """The cards of a list whose URL names their type."""
    return card_list(card_type(query_of(url)["cardcategory"]))(body)


def register(registry: Registry) -> Registry:
    """Add the parsers of this module."""
    registry.register("digimon-en", "v1", "card-list", with_url=True)(card_list_of)
    return registry
