"""Source adapters: registered parsers from captured pages to observation rows.

An adapter is a version of a parser for one source lineage: a function from a
page's body to records.  Adapters run over a table of snapshots in Arrow
batches; what a parser can't read becomes a failure row, never a lost page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Any
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.canon import canonical
from cartulary.sources.html import MOST_RECORDS, MOST_TAGS, MOST_TEXT

RECORD = "snapshot_id string, lineage string, adapter string, ordinal bigint, record string, failure string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Adapter:
    lineage: str
    version: str
    surface: str
    parse: Callable[..., list[dict]]
    with_url: bool = False


class Registry:
    """Adapters by lineage and surface; the latest version of each counts unless one is named."""

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], dict[str, Adapter]] = {}

    def register(self, lineage: str, version: str, surface: str, with_url: bool = False):
        """with_url: the parser also takes the page's URL, which identifies what the page shows."""

        def add(parse: Callable[..., list[dict]]) -> Callable[..., list[dict]]:
            versions = self._found.setdefault((lineage, surface), {})
            if version in versions:
                raise ValueError(f"{lineage} {surface} {version} is registered already")
            versions[version] = Adapter(lineage, version, surface, parse, with_url)
            return parse

        return add

    def get(self, lineage: str, surface: str, version: str | None = None) -> Adapter:
        versions = self._found[lineage, surface]
        return versions[version or max(versions, key=lambda v: [int(x) for x in re.findall(r"\d+", v)])]

    def table(self) -> list[tuple[str, str, str]]:
        return sorted((a.lineage, a.surface, a.version) for versions in self._found.values() for a in versions.values())


def observe(snapshots: DataFrame, registry: Registry, versions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """RECORD rows of snapshots (snapshot_id, lineage, surface, body as text, and perhaps url): canonical records in page order.

    A page without records gives one row with a null record and no failure.  A
    parser that needs a page's URL fails on pages without one.
    """
    chosen = dict(versions or {})
    known = {(lineage, surface): registry.get(lineage, surface, chosen.get((lineage, surface))) for lineage, surface, _ in registry.table()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[Any, ...]] = []
            for sid, lineage, surface, body, url in zip(batch.snapshot_id, batch.lineage, batch.surface, batch.body, batch.url, strict=True):
                adapter = known.get((lineage, surface))
                head = (sid, lineage, adapter.version if adapter else None)
                try:
                    if adapter is None:
                        raise ValueError("no adapter")
                    if len(body or "") > MOST_TEXT:
                        raise ValueError("text too long")
                    if adapter.with_url and not url:
                        raise ValueError("no url")
                    made = adapter.parse(body or "", url) if adapter.with_url else adapter.parse(body or "")
                    if len(made) > MOST_RECORDS:
                        raise ValueError("too many records")
                    rows += [(*head, i, canonical(r), None) for i, r in enumerate(made)] or [(*head, None, None, None)]
                except (ValueError, KeyError, TypeError, RecursionError) as e:
                    rows.append((*head, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["snapshot_id", "lineage", "adapter", "ordinal", "record", "failure"]).astype({"ordinal": "Int64"})

    url = F.col("url") if "url" in snapshots.columns else F.lit(None)
    return snapshots.select("snapshot_id", "lineage", "surface", "body", url.cast("string").alias("url")).mapInPandas(run, RECORD)


def reparse(snapshots: DataFrame, registry: Registry, sets: DataFrame, versions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """set_id and RECORD rows of the snapshots that have no observation set of their adapter's (chosen) version yet.

    sets: set_id of those that are kept.  A set is named by its snapshot, its
    adapter and the version, so parsing again under a version that has been run
    gives nothing, and a new version a set beside the old one.
    """
    chosen = dict(versions or {})
    names = {f"{lineage}/{surface}": registry.get(lineage, surface, chosen.get((lineage, surface))).version for lineage, surface, _ in registry.table()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    version = F.try_element_at(table, F.concat_ws("/", "lineage", "surface"))
    set_id = F.concat(F.lit("set_"), F.sha2(F.concat_ws("\x1f", F.col("snapshot_id").cast("string"), "lineage", "surface", version), 256))
    named = snapshots.where(version.isNotNull()).withColumn("set_id", set_id)
    new = named.join(sets.select("set_id").distinct(), "set_id", "left_anti")
    # The set's name goes through the parser as the snapshot's id.
    records = observe(new.withColumn("snapshot_id", F.concat_ws("\x1f", "set_id", F.col("snapshot_id").cast("string"))), registry, versions)
    both = F.split("snapshot_id", "\x1f", 2)
    return records.withColumns({"set_id": both[0], "snapshot_id": both[1]})


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: dict = {"tag": "", "attributes": {}, "children": []}
        self.open, self.count = [self.root], 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if self.count > MOST_TAGS:
            raise ValueError("too many tags")
        node = {"tag": tag, "attributes": {k: v or "" for k, v in attrs}, "children": []}
        self.open[-1]["children"].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1]["children"].append(data)


def elements(source: str | dict, tag: str | None = None, **attributes: str) -> Iterator[dict]:
    """Elements of a page or below a node, in document order, with the tag and attributes; class_ asks for one of the classes."""
    cls = attributes.pop("class_", None)
    if isinstance(source, str):
        tree = _Tree()
        tree.feed(source)
        source = tree.root
    stack = [c for c in reversed(source["children"]) if isinstance(c, dict)]
    while stack:
        node = stack.pop()
        stack += [c for c in reversed(node["children"]) if isinstance(c, dict)]
        a = node["attributes"]
        if node["tag"] and tag in (None, node["tag"]) and all(a.get(k) == v for k, v in attributes.items()) and (cls is None or cls in a.get("class", "").split()):
            yield node


def text_of(node: dict) -> str:
    """The text below a node, white space collapsed; a line break counts as white space."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x["tag"] == "br":
            out.append(" ")
        elif x["tag"] not in ("script", "style"):
            stack += reversed(x["children"])
    return " ".join("".join(out).split())


def label_values(html: str, label: str = "dt", value: str = "dd") -> dict[str, str]:
    """Label and value pairs: of each label element the next value element; ValueError if a label comes twice."""
    out: dict[str, str] = {}
    waiting = None
    for node in elements(html):
        if node["tag"] == label:
            waiting = text_of(node)
        elif node["tag"] == value and waiting is not None:
            if waiting in out:
                raise ValueError(f"label twice: {waiting}")
            out[waiting] = text_of(node)
            waiting = None
    return out


def headed_values(node: dict, heading: str = "h3") -> dict[str, str]:
    """Label and value pairs of elements that hold a heading and text after it."""
    out: dict[str, str] = {}
    for parent in elements(node):
        for child in parent["children"]:
            if isinstance(child, dict) and child["tag"] == heading:
                rest = {**parent, "children": [c for c in parent["children"] if c is not child]}
                out.setdefault(text_of(child), text_of(rest))
    return out


def only(source: str | dict, tag: str | None = None, **attributes: str) -> dict:
    """The first element that matches; ValueError if there is none."""
    found = next(elements(source, tag, **attributes), None)
    if found is None:
        raise ValueError(f"no {tag or 'element'} {attributes}")
    return found


def sole(source: str | dict, tag: str | None = None, **attributes: str) -> dict:
    """The one element that matches; ValueError if there is none or more than one."""
    found = list(elements(source, tag, **attributes))
    if len(found) != 1:
        raise ValueError(f"{len(found)} of {tag or 'element'} {attributes}")
    return found[0]


def without(node: dict, cls: str) -> dict:
    """A node without the elements of a class below it."""
    kept = [c if isinstance(c, str) else without(c, cls) for c in node["children"] if isinstance(c, str) or cls not in c["attributes"].get("class", "").split()]
    return {**node, "children": kept}


def query_of(url: str) -> dict[str, str]:
    """The query of a URL; ValueError if a name comes twice."""
    pairs = parse_qsl(urlsplit(url).query, keep_blank_values=True)
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a name twice in the query")
    return dict(pairs)


def links(html: str, pattern: str) -> list[str]:
    """The distinct hrefs that match, in document order."""
    return list(dict.fromkeys(h for n in elements(html, "a") if re.search(pattern, h := n["attributes"].get("href", ""))))


def flight_rows(html: str) -> dict[str, Any]:
    """The rows of a server-rendered payload that a page's scripts push in pieces: id to value.

    Pieces are JSON strings in `push([1, "…"])` calls; joined, they are lines
    `id:value`, whose values are JSON (others, such as module imports, are kept
    as text).  A string `$id` in a value stands for that row.
    """
    pieces = [json.loads(m) for m in re.findall(r'\.push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)', html)]
    rows: dict[str, Any] = {}
    for line in "".join(pieces).split("\n"):
        key, colon, raw = line.partition(":")
        if colon and re.fullmatch(r"[0-9a-f]+", key):
            try:
                rows[key] = json.loads(raw)
            except ValueError:
                rows[key] = raw

    def resolve(x: Any, seen: tuple) -> Any:
        if isinstance(x, str) and (m := re.fullmatch(r"\$L?([0-9a-f]+)", x)) and m[1] in rows:
            if m[1] in seen:
                raise ValueError("reference cycle")
            return resolve(rows[m[1]], (*seen, m[1]))
        if isinstance(x, list):
            return [resolve(y, seen) for y in x]
        return {k: resolve(v, seen) for k, v in x.items()} if isinstance(x, dict) else x

    return {k: resolve(v, (k,)) for k, v in rows.items()}


def payload_members(html: str, *names: str) -> dict[str, Any]:
    """The first object of a page's server-rendered payload that has all of these members; ValueError if there is none."""
    stack = list(reversed(flight_rows(html).values()))
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if all(n in x for n in names):
                return x
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    raise ValueError(f"no {names} in the payload")


def json_records(path: str, fields: dict[str, str]) -> Callable[[str], list[dict]]:
    """A parser for JSON pages: the members of the array at a dotted path, with fields by dotted paths."""

    def at(x: Any, dotted: str) -> Any:
        for k in dotted.split("."):
            x = x.get(k) if isinstance(x, dict) else None
        return x

    def parse(body: str) -> list[dict]:
        members = at(json.loads(body), path)
        if not isinstance(members, list):
            raise ValueError(f"no records at {path}")
        return [{name: at(m, p) for name, p in fields.items()} for m in members]

    return parse


def coverage(records: DataFrame) -> DataFrame:
    """Of each lineage and adapter: pages, records and failures."""
    return records.groupBy("lineage", "adapter").agg(F.countDistinct("snapshot_id").alias("n_pages"), F.count("record").alias("n_records"), F.count("failure").alias("n_failures"))
