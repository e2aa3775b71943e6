"""Canonical text, JSON, identifiers, cursors."""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = r"^[\x00-\x7F]*$"


def canonical(value: Any) -> str:
    """Canonical JSON: NFC strings, keys in the order of their UTF-8 bytes, integers only, no blanks."""

    def clean(x: Any) -> Any:
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if x is None or isinstance(x, bool) or isinstance(x, int):
            return x
        if isinstance(x, list):
            return [clean(y) for y in x]
        if isinstance(x, dict):
            made = {unicodedata.normalize("NFC", k): clean(v) for k, v in x.items()}
            return dict(sorted(made.items(), key=lambda kv: kv[0].encode()))
        raise ValueError(f"no canonical form of {type(x).__name__}")

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; a number with a fraction or text that is no JSON fails."""
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def search_text(text: str) -> str:
    """The search form of one text."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower())


@F.pandas_udf(T.StringType())
def _search_form(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else search_text(t))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def search_form(text: Column) -> Column:
    """NFKC, lower case, NFKC: what searches compare.  ASCII texts need only lower case."""
    return F.when(text.rlike(_ASCII), F.lower(text)).otherwise(_search_form(F.when(~text.rlike(_ASCII), text)))


def nfc(text: Column) -> Column:
    return F.when(text.rlike(_ASCII), text).otherwise(_nfc(F.when(~text.rlike(_ASCII), text)))


def collapsed(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank: equal collapsed forms are equal but for formatting."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def dash_to_null(text: Column) -> Column:
    """Null for texts of dashes alone."""
    return F.when(F.trim(text).rlike(r"^[-‐‑‒–—―−\s]*$"), None).otherwise(F.trim(text))


def identifier(prefix: str, *parts: Column) -> Column:
    """A stable identifier of the parts: the prefix and a digest in which nulls and edges count."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256))


def fill_gaps(first: Any, other: Any) -> Any:
    """first with what it lacks taken from other: null and missing keys are gaps, arrays are whole."""
    if first is None:
        return other
    if isinstance(first, dict) and isinstance(other, dict):
        return {k: fill_gaps(first.get(k), other.get(k)) for k in {**other, **first}}
    return first


@F.pandas_udf(T.StringType())
def filled(first: pd.Series, other: pd.Series) -> pd.Series:
    """fill_gaps of JSON texts, canonical."""
    load = lambda t: None if t is None else json.loads(t)
    return pd.Series([canonical(fill_gaps(load(a), load(b))) for a, b in zip(first, other, strict=True)])


def _collapse(x: Any) -> Any:
    if isinstance(x, str):
        return " ".join(x.split())
    if isinstance(x, list):
        return [_collapse(y) for y in x]
    return {k: _collapse(v) for k, v in x.items()} if isinstance(x, dict) else x


@F.pandas_udf(T.StringType())
def formatting_form(text: pd.Series) -> pd.Series:
    """The canonical form of JSON texts with white space collapsed in every string: equal but for formatting."""
    return text.map(lambda t: None if t is None else canonical(_collapse(json.loads(t))))


def encode_cursor(route: str, revision: str, order: str, filters: dict, keys: list) -> str:
    """An opaque cursor that is bound to the route, revision, order and filters it was made for."""
    text = canonical({"route": route, "revision": revision, "order": order, "filters": filters, "keys": keys})
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, route: str, revision: str, order: str, filters: dict) -> list:
    """The keys of a cursor; ValueError if it was made for something else or is damaged."""
    try:
        made = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        bound = {k: made[k] for k in ("route", "revision", "order", "filters")}
        keys = made["keys"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if canonical(bound) != canonical({"route": route, "revision": revision, "order": order, "filters": filters}):
        raise ValueError("the cursor belongs to another request")
    return keys


def etag(request: dict) -> str:
    return hashlib.sha256(canonical(request).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def _etag(requests: pd.Series) -> pd.Series:
    return requests.map(lambda t: etag(json.loads(t)))


def etags(request: Column) -> Column:
    """etag of each request, a struct."""
    return _etag(F.to_json(request, {"ignoreNullFields": "false"}))


def page_limit(raw: str | None, default: int = 50, most: int = 100) -> int:
    """The limit parameter: 1 to most."""
    if raw is None:
        return default
    if not raw.isascii() or not raw.isdigit() or not 1 <= int(raw) <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return int(raw)


def backoff_ms(attempt: int, jitter_ms: int = 0, base: int = 500, most: int = 8000) -> int:
    """The wait before the retry after the attempt-th failure."""
    return min(most, base * 2 ** (attempt - 1)) + min(250, max(0, jitter_ms))
