"""Partial dates: day, month, quarter, season, year or unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of seasons and of undecided dates, and what marks a date as open to change.
SEASONS = ("spring", "summer", "autumn", "fall", "winter")
UNDECIDED = ("", "-", "tba", "tbd", "to be announced", "to be determined", "unknown", "not announced")
TENTATIVE = r"(?i)\(\s*(?:tentative|subject to change)\s*\)|subject to change|tentative"
#: Shapes of whole days and of months, and Spark's patterns of them; words in any case, commas left out.
DAYS = {r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^[A-Za-z]+ \d{1,2} \d{4}$": "MMMM d yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$": "d MMMM yyyy"}
MONTHS = {r"^\d{4}-\d{2}$": "yyyy-MM", rf"^(?i)(?!{'|'.join(SEASONS)})[a-z]+ \d{{4}}$": "MMMM yyyy"}

# A day, its words in either order, with what follows it.
_DAY = r"^(\d{4}-\d{2}-\d{2}|[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})(?:\s+(\S.*))?$"
_QUARTER, _YEAR_QUARTER = r"^q[1-4]\s+\d{4}$", r"^\d{4}[\s-]+q[1-4]$"
_MONTH = r"^(\d{4}-\d{2}|[A-Za-z]+,?\s+\d{4})$"


def _parsed(text: Column, patterns: dict[str, str]) -> Column:
    """The date that the pattern of its shape reads; null for no shape, and for days that no calendar has."""
    plain = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\s+", " ")
    # A pattern that fails costs an exception, so only that of the shape is tried.
    return F.coalesce(*[F.when(plain.rlike(shape), F.try_to_date(plain, p)) for shape, p in patterns.items()])


def partial_date(raw: Column) -> Column:
    """struct(precision, value, tentative, qualifier) of a publisher's words.

    Read are: a day (ISO, `September 30, 2022`, `30 September 2022`), with any
    words after it kept as qualifier; a month (ISO, `September 2025`, with or
    without a comma); a quarter (`Q3 2024`, `2024 Q3`, `2024-Q3`); a season
    (`Winter 2026`, with or without a comma); a year; an undecided date.  A
    marker like `(Subject to change)` makes the date tentative.  precision is
    invalid, with a null value, for what is none of these, no calendar day, or
    undecided and tentative; null for null.
    """
    given = F.trim(raw)
    read = F.struct(given.rlike(TENTATIVE).alias("tentative"), F.trim(F.regexp_replace(given, TENTATIVE, "")).alias("text"))
    none = F.lit(None).cast("string")
    nothing = F.struct(none.alias("precision"), none.alias("value"), F.lit(False).alias("tentative"), none.alias("qualifier"))
    return F.when(raw.isNull(), nothing).otherwise(_once(read, _of_text))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out just once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_text(read: Column) -> Column:
    text, lower = read["text"], F.lower(read["text"])
    parsed = F.struct(_parsed(F.regexp_extract(text, _DAY, 1), DAYS).alias("day"), _parsed(F.regexp_extract(text, _MONTH, 1), MONTHS).alias("month"), lower.alias("lower"))

    def find(x: Column) -> Column:
        lower = x["lower"]
        quarter, season = rf"{_QUARTER}|{_YEAR_QUARTER}", rf"^({'|'.join(SEASONS)}),?\s+(\d{{4}})$"
        of_quarter = F.concat(F.regexp_extract(lower, r"\d{4}", 0), F.lit("-Q"), F.regexp_extract(lower, "q([1-4])", 1))
        of_season = F.concat(F.regexp_extract(lower, season, 2), F.lit("-"), F.regexp_replace(F.regexp_extract(lower, season, 1), "^fall$", "autumn"))
        none = F.lit(None).cast("string")

        def found(precision: str, value: Column) -> Column:
            return F.struct(F.lit(precision).alias("p"), value.alias("v"))

        return (
            F.when(lower.isin(*UNDECIDED), F.when(read["tentative"], found("invalid", none)).otherwise(found("unknown", none)))
            .when(x["day"].isNotNull(), found("day", F.date_format(x["day"], "yyyy-MM-dd")))
            .when(x["month"].isNotNull(), found("month", F.date_format(x["month"], "yyyy-MM")))
            .when(lower.rlike(r"^\d{4}$"), found("year", lower))
            .when(lower.rlike(quarter), found("quarter", of_quarter))
            .when(lower.rlike(season), found("season", of_season))
            .otherwise(found("invalid", none))
        )

    def result(f: Column) -> Column:
        qualifier = F.when(f["p"] == "day", F.nullif(F.regexp_extract(text, _DAY, 2), F.lit("")))
        return F.struct(f["p"].alias("precision"), f["v"].alias("value"), read["tentative"].alias("tentative"), qualifier.alias("qualifier"))

    return _once(parsed, lambda x: _once(find(x), result))
