from pyspark.sql import functions as F

from cartulary.functions import rarities
from cartulary.sources import census

SETS = "set_id string, reported long, official long"


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_inventory(spark):
    sets = spark.createDataFrame([("a", 3, 3), ("p", 2, 2), ("q", 2, 2), ("t", 1, 1), ("t", 1, 1)], SETS)
    digital = spark.createDataFrame([("p", 2, 2), ("q", 2, 1), ("z", 1, 1)], SETS)
    got = {k: v[-1] for k, v in rows(census.inventory(sets, digital)).items()}
    assert got == {"a": "candidate", "p": "excluded", "q": "disagrees", "t": "repeated", "z": "disagrees"}
    assert {v[-1] for v in rows(census.inventory(sets, digital.limit(0))).values()} == {"candidate", "repeated"}


def test_sets_are_qualified(spark):
    pages = [("a", "sv", "2024-01-01", 2, 2), ("b", "sv", "2027-01-01", 1, 1), ("c", "new", "2024-01-01", 1, 1), ("d", "sv", "soon", 2, 2), ("e", "sv", None, 1, 1), ("f", "sv", "2024-01-01", 1, 1), ("g", "sv", "2024-01-01", 2, 1), ("h", None, None, 0, 0)]
    details = spark.createDataFrame(pages, "set_id string, series string, released string, reported long, official long")
    candidates = details.select("set_id", F.when(F.col("set_id") == "e", 9).otherwise(F.col("reported")).alias("reported"), "official")
    listed = [("a", "a-1", "1"), ("b", "b-1", "1"), ("c", "c-1", "1"), ("d", "d-1", "1"), ("d", "d-2", "2"), ("e", "e-1", "1"), ("f", "x-1", "1"), ("g", "g-1", "1"), ("g", "g-1", "1")]
    cards = spark.createDataFrame(listed, "set_id string, card_id string, local_id string")
    bad = (None, None, None, None, True)
    assert rows(census.qualify(candidates, details, cards, "2026-09-15")) == {
        "a": ("issued_set_candidate", None, 1, 1, False), "b": ("not_yet_issued", "not_yet_issued", 1, None, False),
        "c": ("unresolved", "unresolved_series", 1, None, False), "d": ("unresolved", "unresolved_release_date", 2, None, False),
        "e": bad, "f": bad, "g": bad, "h": ("unresolved", "unresolved_series", 0, None, False),
    }


def test_rarities(spark):
    raw = ["C", "Super Rare", "LR ++", "R★", "-", "+", "", None, "LR+++", "sr"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string").select(rarities.digimon(F.col("raw")).alias("d"), rarities.gundam(F.col("raw")).alias("g"))
    d, g = ([tuple(r[k]) for r in df.collect()] for k in (0, 1))
    none, bad = (None, True), (None, False)
    assert d == [("common", True), ("super-rare", True), bad, bad, bad, bad, bad, none, bad, ("super-rare", True)]
    assert g == [("common", True), bad, ("legend-rare", True), ("rare", True), none, bad, bad, none, bad, bad]
