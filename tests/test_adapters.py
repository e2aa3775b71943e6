import json

import pytest

from cartulary.sources import adapters

PAGE = '<div class="card big" id="a"><h1>Ann &amp; Bo</h1><dl><dt>Cost</dt><dd>3</dd><dt>Text</dt><dd>Draw<br>one <b>card</b></dd></dl></div><a href="/p/1">x</a><a href="/q">y</a><a href="/p/1">z</a><img src="i">'


def registry():
    r = adapters.Registry()
    r.register("json", "v2", "list")(adapters.json_records("data.cards", {"id": "id", "name": "names.en"}))
    r.register("json", "v10", "list")(adapters.json_records("data.cards", {"id": "id", "name": "names.en", "v": "v"}))
    r.register("site", "v1", "detail")(lambda body: [adapters.label_values(body)] if "<dl>" in body else [])
    return r


def test_html_primitives():
    (card,) = adapters.elements(PAGE, "div", class_="card")
    assert card["attributes"]["id"] == "a" and adapters.text_of(card) == "Ann & BoCost3TextDraw one card"
    assert adapters.label_values(PAGE) == {"Cost": "3", "Text": "Draw one card"}
    assert adapters.links(PAGE, r"^/p/\d+$") == ["/p/1"]
    with pytest.raises(ValueError):
        adapters.label_values("<dt>a</dt><dd>1</dd><dt>a</dt><dd>2</dd>")


def test_flight_payload():
    text = '1:{"cards":["$2","$3"]}\n2:{"name":"Ann"}\n3:"$2"\n4:I["mod"]\n'
    html = "".join(f"<script>self.f.push([1,{json.dumps(text[i : i + 20])}])</script>" for i in range(0, len(text), 20))
    rows = adapters.flight_rows(html)
    assert rows["1"] == {"cards": [{"name": "Ann"}, {"name": "Ann"}]} and rows["4"] == 'I["mod"]'
    loop = json.dumps('1:"$2"\n2:"$1"\n')
    with pytest.raises(ValueError):
        adapters.flight_rows(f"<script>f.push([1,{loop}])</script>")


def test_observation(spark):
    body = '{"data":{"cards":[{"id":"1","names":{"en":"A"},"v":2},{"id":"2"}]}}'
    rows = [("s1", "json", "list", body), ("s2", "json", "list", "{}"), ("s3", "site", "detail", PAGE), ("s4", "site", "detail", "<p>"), ("s5", "other", "list", "x"), ("s6", "json", "list", None)]
    df = spark.createDataFrame(rows, "snapshot_id string, lineage string, surface string, body string")
    got = adapters.observe(df, registry())
    found = {(r.snapshot_id, r.ordinal): r for r in got.collect()}
    assert json.loads(found["s1", 0].record) == {"id": "1", "name": "A", "v": 2} and found["s1", 0].adapter == "v10"
    assert json.loads(found["s1", 1].record)["name"] is None
    assert "no records" in found["s2", None].failure and found["s4", None].failure is None
    assert json.loads(found["s3", 0].record) == {"Cost": "3", "Text": "Draw one card"}
    assert "no adapter" in found["s5", None].failure and "JSONDecodeError" in found["s6", None].failure
    old = adapters.observe(df, registry(), {("json", "list"): "v2"}).where("snapshot_id = 's1'").collect()
    assert all("v" not in json.loads(r.record) for r in old)
    assert {(r.lineage, r.n_pages, r.n_records, r.n_failures) for r in adapters.coverage(got).collect()} == {("json", 3, 2, 2), ("site", 2, 1, 0), ("other", 1, 0, 1)}


def test_sets_are_parsed_once_for_each_version(spark):
    registry = adapters.Registry()
    registry.register("a", "v1", "page")(lambda body: [{"t": body}])
    snapshots = spark.createDataFrame([("1", "a", "page", "x"), ("2", "a", "page", "y"), ("3", "b", "page", "z")], "snapshot_id string, lineage string, surface string, body string")
    none = spark.createDataFrame([], "set_id string")
    first = adapters.reparse(snapshots, registry, none).collect()
    assert [(r.snapshot_id, r.adapter, r.record) for r in sorted(first)] and {r.snapshot_id for r in first} == {"1", "2"} and len({r.set_id for r in first}) == 2
    sets = spark.createDataFrame([(r.set_id,) for r in first], "set_id string")
    assert adapters.reparse(snapshots, registry, sets).count() == 0
    registry.register("a", "v2", "page")(lambda body: [{"u": body}, {"u": 1}])
    again = adapters.reparse(snapshots, registry, sets).collect()
    assert len(again) == 4 and {r.adapter for r in again} == {"v2"} and not {r.set_id for r in again} & {r.set_id for r in first}
    assert adapters.reparse(snapshots, registry, sets, {("a", "page"): "v1"}).count() == 0
