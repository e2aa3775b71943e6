"""Parsers of the publisher's card pages and product index of a game whose leaders have two faces."""

from __future__ import annotations

import re

from cartulary.sources.adapters import Registry, elements, label_values, only, query_of, sole, text_of, without
from cartulary.sources.cards import _digest, _listed, _number, _printing

# The publisher's card locators, marks of corrected fields, and sections of products.
LOCATOR = r"([A-Z]{1,6}[0-9]{0,3}-[A-Z0-9]{1,6})(_[A-Za-z0-9-]+)?"
CORRECTED = "(Errata Applied)"
CORRECTABLE = ("Skills", "Special Traits")
SECTIONS = {"available": ("AVAILABLE NOW", "released"), "comingsoon": ("COMING SOON", "announced")}
FACES = ("front", "back")


def locator_of(url: str) -> tuple[str, str]:
    """Card number and variant (base, or a suffix) that a card page's URL names."""
    query = query_of(url)
    if not set(query) <= {"card_no", "p"}:
        raise ValueError("an unknown name in the query")
    read = re.fullmatch(LOCATOR, query["card_no"].strip() + query.get("p", "").strip())
    if read is None:
        raise ValueError("no card locator")
    return read[1], read[2] or "base"


def _face(node: dict) -> str | None:
    return next((f for f in FACES if f"is-{f}" in node["attributes"].get("class", "").split()), None)


def _cells(body: str) -> dict[str, dict]:
    """Label to the nodes of a field by face (None: of both) and the faces whose text is a corrected one, with the notice."""
    out: dict[str, dict] = {}
    for cell in elements(body, class_="cardDataCell"):
        heading = only(cell, "h6")
        marked = [_face(x) for x in elements(heading, "span") if text_of(x) == CORRECTED]
        label = text_of(heading).split(CORRECTED)[0].strip()
        values: dict[str | None, dict] = {}
        notices: dict[str | None, str] = {}
        for x in elements(cell, "div", class_="data"):
            values.setdefault(_face(x), without(x, "cardNotesBtnCol"))
            for a in elements(x, "a", class_="cardNotesBtn"):
                notices[_face(x) or "front"] = a["attributes"].get("href", "")
        if label in out or len(set(marked)) < len(marked) or set(marked) != set(notices) or (marked and label not in CORRECTABLE):
            raise ValueError(f"field {label} is unclear")
        out[label] = {"values": values, "notices": notices}
    return out


def card_detail(body: str, url: str) -> list[dict]:
    """The card of a page, which has to be the one its URL names; where a text is a corrected one, what was printed stays open."""
    number, variant = locator_of(url)
    if text_of(sole(body, "div", class_="cardNo")) != number:
        raise ValueError("the locator and the card disagree")
    cells = _cells(body)

    def node(label: str, face: str | None = None) -> dict:
        values = cells[label]["values"]
        return next(values[f] for f in (face, None, "front") if f in values)

    def text(label: str, face: str | None = None) -> str:
        return text_of(node(label, face))

    def icons(label: str) -> list[str]:
        marks = (re.search(r"\bcostIcon-(\w+)", x["attributes"].get("class", "")) for x in elements(node(label), "span"))
        return [m[1].lower() for m in marks if m]

    kind = "_".join(text("Card type").lower().split())
    leader = kind == "leader"
    if not leader and any(set(c["notices"]) - {"front"} for c in cells.values()):
        raise ValueError("a correction of a face that the card lacks")
    rarities = [text_of(x) for x in elements(body, "div", class_="rarity")]
    if len(rarities) != (kind != "energy_marker"):
        raise ValueError("the rarity is unclear")
    tokens = [x["attributes"]["data-color"] for x in elements(node("Color")) if "data-color" in x["attributes"]]
    colours = tokens or _listed(text("Color")) or (["colourless"] if text("Color") == "-" else [])
    costs = icons("Specified cost")
    if not kind or not colours or not text("Where to get it") or (not costs and text("Specified cost") != "-"):
        raise ValueError("the card is incomplete")
    names = {_face(x): text_of(x) for x in elements(body, "h1", class_="cardName")}
    images = {f: only(x, "img")["attributes"]["src"] for f in FACES for x in elements(body, "div", class_=f"img-{f}")} if leader else {"front": only(only(body, "div", class_="cardImage"), "img")["attributes"]["src"]}
    if leader and (set(images) != set(FACES) or sum(1 for f in FACES for _ in elements(body, "div", class_=f"img-{f}")) != 2 or not set(FACES) <= set(names)):
        raise ValueError("a leader's face is missing")
    faces = [{"role": f, "name": names[f], "power": _number(text("Power", f)), "traits": _listed(text("Special Traits", f)), "skills": text("Skills", f)} for f in FACES] if leader else []
    rules = text("Skills", "front")
    name = faces[0]["name"] if leader else names.get(None, names.get("front"))
    if not name or not rules or not all(f["skills"] for f in faces):
        raise ValueError("name or skills are missing")
    attributes = {
        "card_type": kind, "colours": sorted({c.lower() for c in colours}), "cost": _number(text("Cost")),
        "specified_cost": [{"colour": c, "count": costs.count(c)} for c in sorted(set(costs))], "power": _number(text("Power", "front")), "combo_power": _number(text("Combo power")),
        "traits": _listed(text("Special Traits", "front")), "skills": [{"kind": "ordinary", "text": rules}], **({"leader_faces": faces} if leader else {}),
    }
    head = {"category": "gameplay", "name": name, "rules_text": rules, "attributes": attributes, "design": number, "review": []}
    locator = number if variant == "base" else number + variant
    made = _printing("fusion-world", locator, variant, f"{number}:{variant}", rarities[0] if rarities and rarities[0] else None, {})
    made["identity"]["printed_digest"] = _digest([number, variant, rarities, attributes])
    corrected = sorted((label, face, href) for label, c in cells.items() for face, href in c["notices"].items())
    return [
        {
            "card": head, **made, "printed_rules": None if "front" in cells["Skills"]["notices"] else rules, "images": images,
            "corrected": [{"field": label, "face": face, "notice": href} for label, face, href in corrected],
            "memberships": [{"kind": "context", "label": text("Where to get it")}],
        }
    ]


def product_index(body: str) -> list[dict]:
    """The products of both sections of the index (available, coming soon); both have to be there and be linked, and no others."""
    sections = {x["attributes"].get("id"): x for x in elements(body, "section", class_="contentsColInner")}
    anchors = {a["attributes"].get("href", "")[1:]: text_of(a) for li in elements(body, "li", class_="ankerListItem") for a in elements(li, "a")}
    if anchors != {k: heading for k, (heading, _) in SECTIONS.items()} or set(sections) != set(SECTIONS):
        raise ValueError("the sections are incomplete")
    out = []
    for key, (_, status) in SECTIONS.items():
        for item in elements(sections[key], "li", class_="cardCol"):
            facts = label_values(item)
            title = text_of(only(item, "h3", class_="cardText"))
            if not title or "RELEASE" not in facts or not set(facts) <= {"RELEASE", "MSRP"}:
                raise ValueError("a product is incomplete")
            out.append({"name": title, "url": only(item, "a", class_="cardLink")["attributes"]["href"], "status": status, "released": facts["RELEASE"], "price": facts.get("MSRP")})
    return out


def register(registry: Registry) -> Registry:
    """Add the parsers of this module."""
    registry.register("fusion-world-en", "v1", "card-detail", with_url=True)(card_detail)
    registry.register("fusion-world-en", "v1", "products")(product_index)
    return registry
