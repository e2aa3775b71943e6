import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartulary.catalogue import indexes
from cartulary.catalogue.store import Catalogue
from cartulary.functions.canon import search_text


def cards(spark, game, rows):
    shaped = [(f"{game}-{i:04d}", game, "name", None, n, t) for i, (n, t) in enumerate(rows)]
    return spark.createDataFrame(shaped, "id string, game string, identity_kind string, identity_value string, name string, rules_text string").repartition(8, "id")


TEXTS = [("Walker", "Draw two cards."), ("Ünïcode Ring", None), (None, None), ("ab", "zz"), ("", ""), ("aaaa", "aaaaaaaa"), ("drawn", "to the end"), ("𝔘x𝔘y", "x𝔘y"), ("ﬁre", "Straße")]


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    c = Catalogue(spark, str(tmp_path_factory.mktemp("indexed")))
    first = c.publish("g1", None, cards=cards(spark, "g1", TEXTS + [(f"Filler {i}", f"text {i} " * (1 + i % 5)) for i in range(200)]))
    c.publish("g2", first, cards=cards(spark, "g2", TEXTS).withColumn("extra", F.lit(1)))
    return c


@pytest.mark.parametrize("q", ["draw", "aaa", "𝔘y", "x𝔘y", "filler 19", "ﬁr", "fir", "straß", "r", "zz", " walker ", "two cards.", "aaaaaaaaa", "text 3 text", "no such thing", "k d"])
def test_postings_find_what_a_scan_finds(catalogue, q):
    every = catalogue.at().entities("cards")
    want = {r.id for r in every.where(F.exists("search_text", lambda x: F.contains(x, F.lit(search_text(q.strip()))))).collect()}
    assert {r.id for r in catalogue.at().search("cards", q).collect()} == want
    assert {r.id for r in catalogue.at().find("cards", game="g1", q=q).df.collect()} == {i for i in want if i.startswith("g1")}
    assert q not in ("draw", "aaa", "𝔘y", "fir") or want


def test_a_search_reads_the_files_of_its_candidates(catalogue):
    snapshot = catalogue.at()
    batch = snapshot.batches["g1"]
    every = set(snapshot.entities("cards", "g1").inputFiles())
    read = {f for f in snapshot.search("cards", "Filler 133", "g1").inputFiles() if "/entities/" in f}
    assert len(every) == 8 and len(read) == 1
    postings = catalogue.index("cards", batch).candidates("filler 133").inputFiles()
    assert not any("/entities/" in f for f in postings)
    assert {f for f in snapshot.search("cards", "zzzz", "g1").inputFiles() if "/entities/" in f} == set()


def test_a_lookup_reads_one_file_and_one_folder_of_the_index(catalogue):
    snapshot = catalogue.at()
    assert snapshot.get("cards", "g1-0007")["name"] == "𝔘x𝔘y" and snapshot.get("cards", "g1-0007").get("extra") is None
    assert snapshot.get("cards", "g2-0000")["extra"] == 1
    assert snapshot.get("cards", "g9-0000") is None and snapshot.get("cards", "") is None
    batch = snapshot.batches["g1"]
    assert len(catalogue.index("cards", batch).file_of("g1-0100")) == 1
    plan = catalogue.index("cards", batch).read("ids").where((F.col("bucket") == indexes._bucket(F.lit("g1-0100"), "ids")) & (F.col("key") == "g1-0100"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and "xxhash64" not in plan  # folded, so folders are pruned


def test_damaged_buckets_are_found_and_made_again(spark, catalogue):
    snapshot = catalogue.at()
    index = catalogue.index("cards", snapshot.batches["g1"])
    good = sorted(map(tuple, index.read("grams").collect()))
    assert index.damaged().count() == 0 and index.repair() == 0
    buckets = sorted(r.bucket for r in index.read("grams").select("bucket").distinct().collect())
    spark.createDataFrame([(5, "nobody")], "key bigint, id string").write.mode("append").parquet(f"{index.folder}/grams/bucket={buckets[0]}")
    index.files.remove(f"{index.folder}/grams/bucket={buckets[1]}")
    for name in index.files.list(f"{index.folder}/grams/bucket={buckets[2]}"):
        if name.endswith(".parquet"):
            index.files.remove(f"{index.folder}/grams/bucket={buckets[2]}/{name}")
            index.files.create(f"{index.folder}/grams/bucket={buckets[2]}/{name}", "no parquet")
    index.files.remove(f"{index.folder}/ids")
    bad = index.damaged().collect()
    assert {(r.part, r.bucket) for r in bad if r.part == "grams"} == {("grams", b) for b in buckets[:3]} and any(r.part == "ids" for r in bad)
    assert index.repair(most=2) == len(bad) - 2
    while index.repair(most=7):
        pass
    assert index.damaged().count() == 0 and sorted(map(tuple, index.read("grams").collect())) == good
    assert snapshot.get("cards", "g1-0000")["name"] == "Walker"


def test_grams(spark):
    rows = [(["abcab", "xab"],), (["ab", None],), (None,), (["aaaa"],), (["a𝔘b"],), (["a\nb"],), ([],)]
    made = spark.createDataFrame(rows, "t array<string>").select("t", indexes.grams(F.col("t")).alias("g"))
    texts = made.select("t", F.transform("g", indexes.gram_text).alias("g")).collect()
    assert [sorted(r.g) for r in texts] == [["abc", "bca", "cab", "xab"], [], [], ["aaa"], ["a𝔘b"], ["a\nb"], []]


def test_many_ids_and_values_at_once(spark, catalogue):
    ids = spark.createDataFrame([("g1-0001",), ("g2-0003",), ("g2-0003",), ("nobody",), (None,)], "x string")
    snapshot = catalogue.at()
    found = snapshot.lookup("cards", ids)
    assert sorted((r.id, r.name) for r in found.collect()) == [("g1-0001", "Ünïcode Ring"), ("g2-0003", "ab")]
    assert len([f for f in found.inputFiles() if "/entities/" in f]) <= 2
    assert snapshot.lookup("cards", ids.where("x = 'nobody'")).count() == 0
    values = spark.createDataFrame([("Walker",), ("Filler 3",), ("none",), (None,)], "x string")
    assert {r.value: r.known for r in snapshot.known_values("cards", "name", values, "g2").collect()} == {"Walker": True, "Filler 3": False, "none": False}


def test_a_stored_row_holds_the_ids_of_a_batch_of_texts(spark, catalogue):
    index = catalogue.index("cards", catalogue.at().batches["g1"])
    stored, each = index.stored("grams").collect(), index.read("grams").collect()
    assert sum(len(r.ids) for r in stored) == len(each) > 3 * len(stored)
    assert len({(r.key, r.id) for r in each}) == len(each)


def test_postings_of_texts_with_compatibility_forms(spark, tmp_path):
    """A form's grams that the text has not are left out, as are texts without an id."""
    from cartulary.plans.registry import QUERIES

    rows = [(1, "en", "ofﬁce fire"), (2, "en", "OFFICE"), (3, "en", None), (4, "en", "ab"), (None, "en", "xyzzy ﬁx"), (5, "en", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.gram: r.n_cards for r in QUERIES["q_repaired_postings"](spark, str(tmp_path)).collect()}
    assert found == {"off": 1, "ffi": 1, "fic": 1, "ice": 1, "e f": 1, "ce ": 1, " fi": 1, "fir": 1, "ire": 1}


def test_texts_are_published_in_small_batches(spark):
    """The Python of a publication holds batches of bounded bytes; the session's limit is as before."""
    from cartulary.operators.lineage import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('word ', 2000) AS text")
    with small_batches(spark):
        assert texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 8 << 20
    assert spark.conf.get(key, None) == before


def test_a_long_text_is_looked_at_by_pieces(monkeypatch):
    """Memory follows the distinct grams, not the length; the grams across the edges of pieces are there."""
    text = "wörter und 𝔘 " * 200_000
    tracemalloc.start()
    try:
        made = indexes.codes(text).tolist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == indexes.codes("wörter und 𝔘 " * 2).tolist() and peak < 32 << 20
    short = "abcdefghijk"
    whole = indexes.codes(short).tolist()
    for piece in range(1, 12):
        monkeypatch.setattr(indexes, "PIECE", piece)
        assert indexes.codes(short).tolist() == whole and [len(indexes.codes(short[:n])) for n in range(5)] == [0, 0, 0, 1, 2]
