"""Rarities as publishers print them, to a common vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The publishers' vocabularies.
DIGIMON = {
    "c": "common", "common": "common", "u": "uncommon", "uncommon": "uncommon", "r": "rare", "rare": "rare",
    "sr": "super-rare", "super rare": "super-rare", "sec": "secret-rare", "secret rare": "secret-rare", "p": "promo", "promo": "promo",
}
GUNDAM = {"C": "common", "U": "uncommon", "R": "rare", "LR": "legend-rare", "P": "promo"}
#: What may follow a Gundam code: one or two plus signs, or a star.
GUNDAM_MARK = "\\s*(\\+{1,2}|[★☆])$"


def _judged(raw: Column, normal: Column, none: Column) -> Column:
    return F.struct(normal.alias("rarity"), (raw.isNull() | none | normal.isNotNull()).alias("supported"))


def _lookup(words: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), key)


def digimon(raw: Column) -> Column:
    """struct(rarity, supported) of a text in any case; null is supported and has no rarity."""
    return _judged(raw, _lookup(DIGIMON, F.lower(raw)), F.lit(False))


def gundam(raw: Column) -> Column:
    """As digimon(), for a code in capitals and its mark; a dash is no rarity."""
    return _judged(raw, _lookup(GUNDAM, F.regexp_replace(raw, GUNDAM_MARK, "")), F.coalesce(raw == "-", F.lit(False)))
