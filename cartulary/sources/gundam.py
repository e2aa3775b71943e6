"""Parsers of the publisher's card pages and correction articles of one game with two regions."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from cartulary.sources.adapters import Registry, elements, label_values, only, text_of
from cartulary.sources.cards import _digest, _listed, _number, _printing

# Forms of the publisher's card numbers, of variants in image names, and its words.
NUMBER = r"[A-Z0-9]+(?:-[A-Z0-9]+)+"
VARIANT = r"_p[1-9][0-9]*"
CORRECTIONS = ("errata", "revision", "correction")
ENGLISH = "English Version"
PARALLEL_TOO = "For the applicable cards, the above shall be regarded as the correct wording"


def _sole(body: str | dict, cls: str) -> str:
    """The text of the one element of a class; ValueError if there is none, more than one, or no text."""
    found = [text_of(x) for x in elements(body, class_=cls)]
    if len(found) != 1 or not found[0]:
        raise ValueError(f"{cls} is incomplete")
    return found[0]


def _dashed(raw: str | None) -> str | None:
    return None if raw is None or not raw.strip("-‐‑–— ") else raw


def card_detail(body: str) -> list[dict]:
    """The card of a detail page; its image's name is its locator, and has to agree with its number."""
    image = only(only(body, class_="cardImage"), "img")["attributes"].get("src", "").split("?")[0]
    locator = image.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    read = re.fullmatch(rf"({NUMBER})({VARIANT})?", locator)
    if read is None or read[1] != _sole(body, "cardNo"):
        raise ValueError("the image and the number disagree")
    number, variant = read[1], read[2] or "base"
    fields = label_values(body)

    def field(*labels: str) -> str | None:
        return next((fields[x] for x in labels if x in fields), None)

    kind, colour, effect = field("TYPE", "Type"), field("COLOR", "Color"), _sole(body, "overview")
    if not kind or not colour:
        raise ValueError("type or colour is missing")
    attributes = {
        "card_type": "_".join(kind.lower().split()), "colours": [x.lower() for x in _listed(colour)], "level": _number(field("Lv.", "Lv", "Level")), "cost": _number(field("COST", "Cost")),
        "block_icon": _dashed(_sole(body, "blockIcon")), "effect_text": effect, "zone": _dashed(field("Zone")), "traits": _listed(field("Trait", "Traits")), "link_condition": _dashed(field("Link")),
        "ap": _number(field("AP")), "hp": _number(field("HP")), "series_titles": _listed(field("Source Title", "Title")),
    }
    token = attributes["card_type"] == "unit_token"
    head = {"category": "token" if token else "gameplay", "name": _sole(body, "cardName"), "rules_text": effect, "attributes": attributes, "design": number, "review": []}
    made = _printing("gundam", locator, variant, locator, _dashed(_sole(body, "rarity")), {"alternate_art": variant != "base"})
    made["identity"]["printed_digest"] = _digest([number, variant, fields, effect])
    return [{"card": head, **made, "memberships": [{"kind": "context", "label": field("Where to get it")}]}]


def corrections(english_part: bool = False) -> Callable[[str], list[dict]]:
    """A parser of articles that correct cards: an entry for each, with both wordings; english_part: of two languages, the English one."""

    def parse(body: str) -> list[dict]:
        if not any(w in text_of(only(body, "h2")).lower() for w in CORRECTIONS):
            raise ValueError("no correction article")
        published = datetime.strptime(text_of(only(body, "div", class_="date")), "%B %d, %Y").date().isoformat()
        entries: list[dict] = []
        notices: list[str] = []
        reading, side = not english_part, None
        for node in elements(only(body, "div", class_="articleBody")):
            tag, a, text = node["tag"], node["attributes"], text_of(node)
            if tag == "h6" and text == ENGLISH:
                reading = True
            if not reading:
                continue
            if tag == "span" and re.search(r"font-size\s*:\s*1\.25em", a.get("style", "")):
                number = text.split(" ")[0]
                if not re.fullmatch(NUMBER, number):
                    raise ValueError("a correction's card is missing")
                entries.append({"card_number": number, "published_on": published, "before": [], "after": [], "images": []})
            elif tag == "h5":
                side = next((w.lower() for w in re.findall(r"\b(?:Before|After)\b", text)), None)
            elif tag == "div" and "text-area" in a.get("class", "").split() and entries and side:
                entries[-1][side].append(text)
                side = None
            elif tag == "img" and entries and entries[-1]["card_number"] in a.get("src", ""):
                entries[-1]["images"].append(a["src"])
            elif tag == "strong" and "correct wording" in text.lower():
                notices.append(text)
        whole = all(len(e[k]) == 1 and e[k][0] for e in entries for k in ("before", "after", "images"))
        if not entries or not whole or len({e["card_number"] for e in entries}) < len(entries) or len(notices) != 1:
            raise ValueError("the corrections are incomplete")
        parallel = notices[0].rstrip(".") == PARALLEL_TOO
        return [{"card_number": e["card_number"], "published_on": e["published_on"], "before": e["before"][0], "after": e["after"][0], "image": e["images"][0], "notice": notices[0], "parallel_printings": parallel} for e in entries]

    return parse


def register(registry: Registry) -> Registry:
    """Add the parsers of this module, for each of the two regions."""
    for region in ("gundam-en-asia", "gundam-en-us"):
        registry.register(region, "v1", "card-detail")(card_detail)
        registry.register(region, "v1", "errata")(corrections(english_part=region == "gundam-en-asia"))
    return registry
