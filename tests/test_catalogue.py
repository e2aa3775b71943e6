import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cartulary.catalogue import export, reconcile, store
from cartulary.catalogue.store import Catalogue, Conflict
from tests.test_operators import PROFILE

CARD = "id string, game string, identity_kind string, identity_value string, name string, rules_text string, attributes string"


def cards(spark, game, n, prefix="c"):
    rows = [(f"{prefix}{i:03d}", game, "number" if i % 3 else None, f"{game}-{i % 50:02d}", f"Name {i} ﬁre", None if i % 4 else f"Draw {i}", f'{{"category":"unit","power":{i},"tags":["t{i % 2}"]}}') for i in range(n)]
    return spark.createDataFrame(rows, CARD)


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    c = Catalogue(spark, str(tmp_path_factory.mktemp("catalogue")))
    printings = spark.createDataFrame([(f"p{i}", f"c{i:03d}", "g1", [f"x{i % 3}"]) for i in range(20)], "id string, card_id string, game string, product_ids array<string>")
    products = spark.createDataFrame([("x0", "g1", None, "Zero", ["EU"]), ("x1", "g1", "A1", None, ["US"]), ("x2", "g1", "A2", "Two", ["EU", "US"])], "id string, game string, official_code string, name string, regions array<string>")
    c.first = c.publish("g1", None, cards=cards(spark, "g1", 60), printings=printings, products=products)
    c.second = c.publish("g2", c.first, cards=cards(spark, "g2", 45, "d"))
    c.third = c.publish("g1", c.second, cards=cards(spark, "g1", 10), printings=printings, products=products)
    return c


def test_revisions_are_pinned(catalogue):
    assert catalogue.current() == catalogue.third
    assert catalogue.at(catalogue.first).games() == ["g1"] and catalogue.at().games() == ["g1", "g2"]
    assert catalogue.at(catalogue.second).entities("cards").count() == 105
    assert catalogue.at().entities("cards").count() == 55 and catalogue.at().entities("cards", "g2").count() == 45
    assert catalogue.at().get("cards", "c003")["name"] == "Name 3 ﬁre" and catalogue.at().get("cards", "c050") is None
    with pytest.raises(KeyError):
        catalogue.at("revision_none")


def test_a_stale_publisher_is_refused(spark, catalogue):
    with pytest.raises(Conflict):
        catalogue.publish("g3", catalogue.first, cards=cards(spark, "g3", 1))
    with pytest.raises(Conflict):
        catalogue.publish("g3", catalogue.third, diagnostics=spark.range(1), cards=cards(spark, "g3", 1))


def test_two_publishers_interleave(spark, tmp_path):
    """One that is overtaken between its look and its record, by a publisher of another game, is refused and leaves no trace in reads."""
    c = Catalogue(spark, str(tmp_path))
    base = c.publish("g1", None, cards=cards(spark, "g1", 3))
    other = Catalogue(spark, str(tmp_path))

    class Overtaken(Catalogue):
        def record(self, revision):
            found = super().record(revision)
            self.won = other.publish("g2", base, cards=cards(spark, "g2", 4))
            return found

    late = Overtaken(spark, str(tmp_path))
    with pytest.raises(Conflict):
        late.publish("g3", base, cards=cards(spark, "g3", 5))
    assert c.current() == late.won and c.revisions().count() == 2 and c.at().games() == ["g1", "g2"]
    assert c.at().entities("cards").count() == 7
    assert c.publish("g3", late.won, cards=cards(spark, "g3", 5)) == c.current() and c.at().games() == ["g1", "g2", "g3"]


def test_a_record_that_is_being_written(spark, tmp_path, monkeypatch):
    c = Catalogue(spark, f"file:{tmp_path}")
    assert c.current() is None
    first = c.publish("g1", None, cards=cards(spark, "g1", 2))
    (tmp_path / "revisions" / "000000000002.json").write_text("")
    with pytest.raises(Conflict):
        c.publish("g1", first, cards=cards(spark, "g1", 3))
    monkeypatch.setattr(store, "STALE_MS", -1)  # its publisher died
    second = c.publish("g1", first, cards=cards(spark, "g1", 3))
    assert c.current() == second and c.at().entities("cards").count() == 3 and c.at(first).entities("cards").count() == 2


def test_an_unreadable_log_is_no_empty_catalogue(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path))
    c.publish("g1", None, cards=cards(spark, "g1", 2))
    (tmp_path / "revisions" / "000000000002.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        c.current()


def test_only_pinned_batches_are_read(catalogue):
    files = catalogue.at().entities("cards").inputFiles()
    assert {f.split("batch=")[1].split("/")[0] for f in files} == set(catalogue.at().batches.values())
    with pytest.raises(KeyError):
        catalogue.at().entities("products", "g2")


def test_pages_walk_the_whole_collection(catalogue):
    query = catalogue.at(catalogue.second).find("cards")
    rows, cursor = query.page(40)
    seen = [r["id"] for r in rows]
    while cursor:
        rows, cursor = query.page(40, cursor)
        seen += [r["id"] for r in rows]
    whole = catalogue.at(catalogue.second).entities("cards").orderBy("game", F.asc_nulls_last("identity_kind"), "identity_value", "id").collect()
    assert seen == [r.id for r in whole]
    _, cursor = query.page(1)
    with pytest.raises(ValueError):
        catalogue.at().find("cards").page(1, cursor)


def test_filters(catalogue):
    at = catalogue.at(catalogue.first)
    ids = lambda *a, **k: [r["id"] for r in at.find(*a, **k).page(100)[0]]
    assert ids("cards", q="FIRE", identity_value="g1-07") == ["c007", "c057"]
    assert ids("cards", q="draw 8") == ["c008"] and ids("cards", q="8 draw") == []
    assert ids("cards", game="g1", attributes={"power": "7"}, profile=PROFILE) == ["c007"]
    assert [r["id"] for r in at.find("products").page()[0]] == ["x1", "x2", "x0"]
    assert {r.id for r in at.printings_in("x1").collect()} == {f"p{i}" for i in range(20) if i % 3 == 1}
    assert at.printings_in(region="EU").count() == 13
    query = at.find("cards", game="g1")
    assert query.known("identity_value", "g1-01") and not query.known("identity_value", "g9")
    assert {(r.attribute, r.value): r.n_cards for r in at.attribute_values("g1").collect()}["tags", '"t0"'] == 30


def test_export_round_trip(spark, catalogue, tmp_path):
    rows = export.components(export.lines(catalogue.at().entities("cards").drop("search_text"), "card", "id"), most=2000)
    assert rows.select("component").distinct().count() > 2
    made = export.write(rows, str(tmp_path / "e"), catalogue.third)
    again = export.write(rows.repartition(5), str(tmp_path / "f"), catalogue.third)
    assert made == again and export.verify(spark, str(tmp_path / "e"))
    files = sorted(p.name for p in (tmp_path / "e" / "components").glob("*.gz"))
    assert files == sorted(f"{e['component']}.jsonl.gz" for e in made["components"])
    for name in files:  # the same bytes, whatever the order and the number of tasks
        body = (tmp_path / "e" / "components" / name).read_bytes()
        assert body == (tmp_path / "f" / "components" / name).read_bytes() and body[4:8] == bytes(4)
        assert hashlib.sha256(gzip.decompress(body)).hexdigest() == next(e["sha256"] for e in made["components"] if name == f"{e['component']}.jsonl.gz")
    (tmp_path / "f" / "components" / ".card-0.jsonl.gz.crc").unlink(missing_ok=True)
    (tmp_path / "f" / "components" / "card-0.jsonl.gz").write_bytes(gzip.compress(b"{}\n"))
    assert not export.verify(spark, str(tmp_path / "f"))


def test_printing_matches(spark):
    facts = "card_id string, artwork string, printed_digest string, rarity string, treatment string"
    seen = [
        ("located", "l1", "k1", "c1", "a1", "d1", "r", None, True, True), ("contradictory", "l1", "k1", "c1", "a9", "d1", "r", None, True, True), ("reviewed", "l1", None, "c1", "a1", "d1", "r", None, True, True),
        ("single", "l2", None, "c1", "a1", "d1", "r", None, True, True), ("inexplicit", "l2", None, "c1", "a1", "d1", "r", None, False, True), ("ambiguous", "l1", None, "c2", "a2", "d2", "r", "foil", True, True),
        ("cross", "l2", None, "c1", "a7", "d1", "r", None, True, True), ("novel", "l1", None, "c9", "a1", "d1", "r", None, True, True), ("unproven", "l1", None, "c8", "a1", "d1", "r", None, True, False), ("same_look", "l1", None, "c1", "a1", "d8", "r", None, True, True),
    ]
    prior = [("p1", "l1", "c1", "a1", "d1", "r", None), ("p2", "l1", "c2", "a2", "d2", "r", "foil"), ("p3", "l2", "c2", "a2", "d2", "r", "foil")]
    observations = spark.createDataFrame([(o, l, k, "base", *rest) for o, l, k, *rest in seen], f"observation_id string, lineage string, locator string, variant string, {facts}, artwork_explicit boolean, novel boolean")
    locators = spark.createDataFrame([("l1", "k1", "base", "p1")], "lineage string, locator string, variant string, printing_id string")
    reviews = spark.createDataFrame([("reviewed", "p7")], "observation_id string, printing_id string")
    got = {r.observation_id: (r.printing_id, r.decision, r.diagnostic) for r in reconcile.match_printings(observations, locators, spark.createDataFrame(prior, f"printing_id string, lineage string, {facts}"), reviews).collect()}
    contradictory, insufficient = "printing_match_contradictory", "printing_match_insufficient_evidence"
    assert got["located"] == ("p1", "located", None) and got["contradictory"] == ("p1", "located", contradictory)
    assert got["reviewed"] == ("p7", "reviewed", None) and got["single"] == ("p1", "matched", None)
    assert got["inexplicit"] == ("p1", "inexplicit", insufficient) and got["ambiguous"] == ("p2", "ambiguous", "printing_match_ambiguous")
    assert got["cross"] == ("p1", "cross_source", insufficient)
    assert got["novel"][1:] == ("allocated", None) and got["unproven"][1:] == ("allocated", insufficient) and got["same_look"][1:] == ("allocated", contradictory)


def test_reconciliation_does_not_depend_on_row_order(spark):
    rows = [(f"o{i}", f"k{i % 7}", f"C{i % 5}" if i % 2 else None, f" Name {i % 6} ") for i in range(60)]
    prior = spark.createDataFrame([(f"p{i}", f"C{i}" if i % 2 else None, f"NAME {i}") for i in range(6)], "product_id string, code string, name string")
    seen = spark.createDataFrame([(o, c, n) for o, _, c, n in rows], "key string, code string, name string")
    one = sorted(map(tuple, reconcile.identify_products(seen, prior).collect()), key=repr)
    assert one == sorted(map(tuple, reconcile.identify_products(seen.orderBy(F.rand(1)), prior.orderBy(F.rand(2))).collect()), key=repr)


def test_matches_carry_only_what_is_asked_for(spark):
    from cartulary.plans.registry import QUERIES

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    match = QUERIES["q_match_printings"](spark, "/root/testdata/sf0.001")
    assert not any(x in plan(match) for x in ("sha2", "exact_id", "review_id AS", "cross_first", "ExistingRDD"))  # no ids of printings are needed for a decision
    corroborated = QUERIES["q_corroborated_match"](spark, "/root/testdata/sf0.001")
    assert not any(x in plan(corroborated) for x in ("cross_", "ExistingRDD"))  # no checkpoint is read, which is several times as large as a table
