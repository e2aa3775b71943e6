from datetime import datetime

from pyspark.sql import functions as F

from cartulary.catalogue import assembly


def test_paragraph_correction(spark):
    df = spark.createDataFrame([("a\nold\nb",), ("old\nold",), ("none",)], "t string")
    assert [r.c for r in df.select(assembly.correct_paragraph(F.col("t"), "old", "new").alias("c")).collect()] == ["a\nnew\nb", None, None]


def test_retry_after(spark):
    cases = {"120": 120, " 5 ": 5, "Wed, 21 Oct 2026 07:28:00 GMT": 60, "Wed, 21 Oct 2020 07:28:00 GMT": 0, "": None, "soon": None, "-1": None}
    df = spark.createDataFrame([(k, datetime(2026, 10, 21, 7, 27)) for k in cases], "h string, now timestamp")
    assert {r.h: r.s for r in df.select("h", assembly.retry_after_seconds(F.col("h"), F.col("now")).alias("s")).collect()} == cases


def test_byte_ranges(spark):
    df = spark.createDataFrame([(b"0123456789", 2, 4), (b"0123456789", 8, 99), (b"0123456789", 10, 12), (b"", 0, 0)], "c binary, a int, b int")
    got = df.select(assembly.byte_range(F.col("c"), F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p and bytes(r.p) for r in got] == [b"234", b"89", None, None]


def test_leaf_coverage(spark):
    rows = spark.createDataFrame([("a.name",), ("faces[0].name",), ("faces[0].extra",), ("tags[3]",)], "attribute string")
    got = {r.attribute: r.consumed for r in assembly.leaf_coverage(rows, "attribute", ["name", "tags"]).collect()}
    assert got == {"a.name": True, "faces[0].name": True, "faces[0].extra": False, "tags[3]": True}


def test_image_link_is_withdrawn_by_the_latest_observation(spark):
    t = lambda d: datetime(2026, 1, d)
    rows = [("p", t(1), "o1", True, "a"), ("p", t(2), "o2", True, None), ("q", t(1), "o3", True, "b"), ("q", t(2), "o4", False, None), ("r", t(1), "o5", True, "c")]
    df = spark.createDataFrame(rows, "printing_id string, captured_at timestamp, observation_id string, opted_in boolean, link string")
    assert {(r.printing_id, r.link) for r in assembly.image_links(df, spark.createDataFrame([("r",)], "printing_id string")).collect()} == {("q", "b")}
