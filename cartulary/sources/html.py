"""Facts of HTML pages: expressions for single facts, a parser for bounded record extraction."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of one page.
MOST_TEXT = 4 << 20
MOST_TAGS = 32_768
MOST_RECORDS = 2_048


def title(html: str) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def n_links(html: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))


def language(html: str) -> Column:
    return F.regexp_extract(html, r'<html[^>]*lang="([^"]*)"', 1)


class _Records(HTMLParser):
    """The text of every element named tag; nested ones belong to the outermost."""

    def __init__(self, tag: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.depth, self.tags, self.found = tag, 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.tags > MOST_TAGS:
            raise ValueError("too many tags")
        if tag == self.tag:
            self.depth += 1
            if self.depth == 1:
                self.found.append([])
                if len(self.found) > MOST_RECORDS:
                    raise ValueError("too many records")

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.found[-1].append(data)


def records(pages: DataFrame, page_id: str, html: str, tag: str) -> DataFrame:
    """page_id, ordinal, record (its text, white space collapsed), failure (why a page gave none).

    A page beyond a limit gives one row with its failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch[page_id], batch[html], strict=True):
                parser = _Records(tag)
                try:
                    if len(body or "") > MOST_TEXT:
                        raise ValueError("text too long")
                    parser.feed(body or "")
                    rows += [(key, i, " ".join("".join(x).split()), None) for i, x in enumerate(parser.found)]
                except ValueError as e:
                    rows.append((key, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[page_id, "ordinal", "record", "failure"]).astype({"ordinal": "Int64"})

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, ordinal bigint, record string, failure string")
