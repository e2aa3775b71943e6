"""Parsers of publishers' correction pages: dated lists of cards, single articles, structured entries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime

from cartulary.sources.adapters import Registry, elements, only, sole, text_of

# The title of one publisher's list, its labels and its words for parallel printings; fields of structured entries.
LIST_TITLE = "Errata Cards"
BEFORE, AFTER, NOTE = "Before:", "After:", "Note:"
PARALLEL_TOO = "also applies to parallel card version."
ENTRY_FIELDS = {
    "digimon-en": {
        "card_number": "card_number",
        "published_on": "published_on",
        "effective_from": "effective_from",
        "before": "observed_printed_rules_text",
        "after": "corrected_rules_text",
        "wording": "official_wording",
        "parallel_printings": "applies_to_parallel_printings",
        "fragment": "source_fragment",
        "name": "display_name",
        "image": "image_url",
    },
    "fusion-world-en": {
        "card_number": "card_number",
        "published_on": "published_on",
        "effective_from": "effective_from",
        "before": "before",
        "after": "after",
        "wording": "notice",
        "fragment": "entry_id",
        "image": "image_url",
    },
}
NUMBER = r"[A-Z]{1,5}[0-9]{0,3}-[A-Z0-9]{1,6}"


def _day(text: str) -> str:
    for form in ("%B %d, %Y", "%b %d, %Y", "%Y/%m/%d", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.removeprefix("Updated on").strip(), form).date().isoformat()
        except ValueError:
            continue
    raise ValueError(f"no day: {text}")


def _entry(node: dict, published: str, fragment: str | None) -> dict:
    """A correction: both wordings once, a note at most once; a day in its heading goes before the section's."""
    heading = text_of(sole(node, "h5", class_="smallTitRed"))
    read = re.fullmatch(rf"(?:(.+\d{{4}}) )?({NUMBER}) (.+)", heading)
    if read is None or any(True for tag in ("p", "ol") for _ in elements(node, tag)):
        raise ValueError("a correction is unclear")
    told: dict[str, str] = {}
    label = None
    for x in elements(node):
        if x["tag"] == "dt":
            label = text_of(x)
            if label not in (BEFORE, AFTER, NOTE) or label in told:
                raise ValueError(f"label {label}")
            told[label] = ""
        elif x["tag"] == "dd":
            if label is None or told[label] or not text_of(x):
                raise ValueError("a wording is unclear")
            told[label] = text_of(x)
    images = [x["attributes"]["src"] for b in elements(node, class_="typographicalImg") for x in elements(b, "img")]
    notices = [text_of(x) for u in elements(node, "ul", class_="commonNoticeList") for x in elements(u, "li")]
    if not {BEFORE, AFTER} <= set(told) or not all(told.values()) or not all(notices) or len(images) != 1 or not images[0].startswith("/") or not fragment:
        raise ValueError("a correction is incomplete")
    return {
        "card_number": read[2], "name": read[3], "published_on": _day(read[1]) if read[1] else published, "fragment": fragment, "before": told[BEFORE], "after": told[AFTER],
        "note": told.get(NOTE), "notices": notices, "image": images[0], "parallel_printings": PARALLEL_TOO in text_of(node).lower(),
    }


def one_piece_corrections(body: str) -> list[dict]:
    """The corrections of a page of dated sections: as many as it has headings, and of every pop-up that it opens."""
    if text_of(sole(body, "h3", class_="pageTit")) != LIST_TITLE:
        raise ValueError("no correction list")
    wrap = sole(body, class_="contentsWrap")
    out: list[dict] = []
    for section in elements(wrap, "section", class_="contentsLCol"):
        published = _day(text_of(sole(section, "h4", class_="mediumTit")))
        found = [x for x in elements(section, "div") if {"detailCol", "errataModal"} & set(x["attributes"].get("class", "").split())]
        if not found:
            raise ValueError("a section without corrections")
        out += [_entry(x, published, x["attributes"].get("id") or section["attributes"].get("id")) for x in found]
    opened = sorted(x["attributes"].get("data-src", "") for x in elements(wrap, "a", class_="modalOpen"))
    shown = sorted("#" + x["attributes"].get("id", "") for x in elements(wrap, "div", class_="errataModal"))
    if not out or len(out) != sum(1 for _ in elements(wrap, "h5", class_="smallTitRed")) or opened != shown or len(set(shown)) < len(shown):
        raise ValueError("the corrections are incomplete")
    return out


def structured(fields: dict[str, str]) -> Callable[[str], list[dict]]:
    """A parser of JSON entries that have these fields (name: the publisher's) and no others; only effective_from may be null."""

    def parse(body: str) -> list[dict]:
        out = []
        for entry in json.loads(body)["entries"]:
            if set(entry) - set(fields.values()):
                raise ValueError(f"unknown fields {sorted(set(entry) - set(fields.values()))}")
            made = {k: entry[f] for k, f in fields.items()}
            for k, v in made.items():
                if k == "parallel_printings" and not isinstance(v, bool):
                    raise ValueError("no flag")
                if k not in ("parallel_printings", "effective_from") and (not isinstance(v, str) or not v.strip()):
                    raise ValueError(f"{k} is missing")
            out.append({"parallel_printings": True, **made})
        return out

    return parse


def pokemon_correction(body: str) -> list[dict]:
    """The correction of an article: the card named with set and number in brackets, the printed wording, then the corrected one."""
    article = sole(body, "article")
    published = _day(only(body, "time")["attributes"]["datetime"])
    wording = text_of(article)
    quoted = [text_of(x) for x in elements(article, "p") if "color" in x["attributes"].get("style", "")]
    named = re.search(r"([^\s(][^(]*?) \(([^()]+?)[,—] ?(\d+/\d+)\)", wording)
    if named is None or len(quoted) != 2 or not all(quoted) or quoted[0] == quoted[1]:
        raise ValueError("the card or its wordings are unclear")
    return [{
        "name": named[1].split(". ")[-1].split(" for ")[-1], "set": re.split(r"[—–]", named[2])[-1].strip(), "collector_number": named[3], "published_on": published,
        "effective_from": published if "Effective immediately" in wording else None, "before": quoted[0], "after": quoted[1], "wording": wording, "parallel_printings": True,
    }]


def register(registry: Registry) -> Registry:
    """Add the parsers of this module."""
    registry.register("one-piece", "v1", "errata")(one_piece_corrections)
    registry.register("pokemon-official", "v1", "errata")(pokemon_correction)
    for lineage, fields in ENTRY_FIELDS.items():
        registry.register(lineage, "v1", "errata")(structured(fields))
    return registry
