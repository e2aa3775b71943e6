import hashlib

import pytest
from pyspark.sql import functions as F

from cartulary.catalogue import profiles, reconcile
from cartulary.functions import canon, dates
from cartulary.operators import evidence, identity, keyset, publish, resolve, search
from cartulary.sources import archives, html
from cartulary.streaming import control, pacing


def test_page_keeps_one_row_whatever_its_size(spark):
    df = spark.createDataFrame([(1, 500), (2, 10), (3, 10)], "k int, n int")
    got = keyset.page(df, [F.asc("k")], F.col("n"), limit=3, budget=100).collect()
    assert [(r.k, r.has_more) for r in got] == [(1, True)]
    assert [r.k for r in keyset.page(df, [F.asc("k")], F.col("n"), limit=3, budget=520).collect()] == [1, 2, 3]
    exact = keyset.page(df, [F.asc("k")], F.col("n"), limit=3).collect()
    assert len(exact) == 3 and not exact[0].has_more
    with pytest.raises(ValueError):
        keyset.page(df, [F.asc("k")], F.col("n"), limit=101)


def test_pages_together_are_the_whole_order(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"c{i % 11}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, code string, id int")
    order = [F.asc("g"), F.asc_nulls_last("code"), F.asc("id")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    seen, cursor = [], None
    while True:
        at = df if cursor is None else df.where(keyset.after_nulls_last(["g", "code", "id"], cursor))
        page = [tuple(r)[:3] for r in keyset.page(at, order, F.lit(1), limit=33).collect()]
        if not page:
            break
        seen += page
        cursor = page[-1]
    assert seen == whole


def test_prefix_sum_over_blocks(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 'a', null) g", "id", "id % 10 v")
    got = {r.id: r.s for r in keyset.prefix_sum(df, "g", "id", F.col("v"), 64, "s").collect()}
    for kind in (0, 1):
        total = 0
        for i in range(1000):
            if (i % 3 == 0) == (kind == 0):
                total += i % 10
                assert got[i] == total


def test_search_stays_within_fields_and_chunks_overlap(spark):
    df = spark.createDataFrame([("ab", "cd"), (None, "bc"), ("x'y", "")], "a string, b string")
    find = lambda q: [tuple(r) for r in df.where(search.contains_any([F.col("a"), F.col("b")], q)).collect()]
    assert find("bc") == [(None, "bc")] and find("x'") == [("x'y", "")]
    text = "".join(chr(97 + i % 26) for i in range(100))
    got = search.chunks(spark.createDataFrame([(text,), ("",), ("short",)], "t string"), F.col("t"), 40, 15).collect()
    own = [r.chunk_text for r in got if r.t == text]
    assert all(any(text[i : i + 26] in c for c in own) for i in range(75)) and own[-1].endswith(text[-1])
    assert len([r for r in got if r.t != text]) == 2


def test_fact_resolution(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1), ("c", "y", 1), ("c", "z", 0), ("d", "p", 3), ("d", "q", 3)]
    got = {r.k: (r.value, r.conflict, r.disagreements) for r in resolve.resolve_facts(spark.createDataFrame(rows, "k string, v string, r int"), ["k"], "v", "r").withColumnRenamed("value", "value").collect()}
    assert got["a"] == ("x", False, 0) and got["b"] == ("x", False, 1) and got["c"] == ("z", False, 2) and got["d"][1]


def test_redirects(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 5)], "s int, t int")
    got = {r.s: (r.final, r.steps) for r in identity.follow(chain, "s", "t").collect()}
    assert got[0] == (20, 20) and got[100] == (20, 16)
    for bad in ([(1, 2), (2, 1)], [(i, i + 1) for i in range(40)]):
        with pytest.raises(Exception, match="redirect cycle"):
            identity.follow(spark.createDataFrame(bad, "s int, t int"), "s", "t").collect()


def test_diff_of_a_set_with_itself_carries_all_forward(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "e")], "id int, s string, e string")
    assert {r.change for r in publish.diff(df, df, ["id"], ["s"], ["e"]).collect()} == {"carry_forward"}
    other = spark.createDataFrame([(1, "a", "new"), (2, "b", "e"), (3, "c", None)], "id int, s string, e string")
    assert {r.id: r.change for r in publish.diff(df, other, ["id"], ["s"], ["e"]).collect()} == {1: "evidence_only", 2: "changed", 3: "added"}
    assert publish.diff(df, other.where("id = 3"), ["id"], ["s"]).where("change = 'removed'").count() == 2


def test_set_digest_does_not_depend_on_row_order(spark):
    df = spark.range(500).selectExpr("id % 3 g", "id", "cast(id as string) line")
    one = publish.set_digest(df, ["g"], "id", F.col("line"), 50).orderBy("g").collect()
    two = publish.set_digest(df.repartition(7).orderBy(F.desc("id")), ["g"], "id", F.col("line"), 50).orderBy("g").collect()
    assert one == two


def test_coverage_thresholds(spark):
    rows = [("small_loss", 100, 76), ("loss", 100, 75), ("gain", 100, 125), ("gone", 200, 0), ("large", 1000, 801), ("large_loss", 1000, 800)]
    before = spark.createDataFrame([(k, b) for k, b, _ in rows], "k string, n bigint")
    after = spark.createDataFrame([(k, a) for k, _, a in rows if a] + [("new", 30)], "k string, n bigint")
    got = {r.k: r.verdict for r in publish.coverage_change(before, after, "k", "n").collect()}
    assert got == {"small_loss": "accepted", "loss": "blocked", "gain": "warned", "gone": "blocked", "large": "accepted", "large_loss": "blocked", "new": "warned"}


def test_evidence_with_another_digest_fails(spark):
    good = spark.createDataFrame([(b"abc",)], "c binary").select("c", F.sha2("c", 256).alias("d"), F.octet_length("c").alias("n"))
    assert evidence.verified(good, "c", "d", "n").first().c == b"abc"
    with pytest.raises(Exception, match="differs from its digest"):
        evidence.verified(good.withColumn("n", F.lit(4)), "c", "d", "n").collect()


def test_partial_dates(spark):
    cases = {
        "2024-02-29": ("day", "2024-02-29", False), "2023-02-30": ("invalid", None, False), "2024-05": ("month", "2024-05", False), "Q3 2024": ("quarter", "2024-Q3", False), "Summer 2025": ("season", "2025-summer", False),
        "fall 2025": ("season", "2025-autumn", False), "2026": ("year", "2026", False), "TBA": ("unknown", None, False), "2026 (tentative)": ("year", "2026", True), "2024-05-01 subject to change": ("day", "2024-05-01", True), "soon": ("invalid", None, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", dates.partial_date(F.col("raw")).alias("p"))
    assert {r.raw: tuple(r.p)[:3] for r in df.collect()} == cases
    cases = {
        "September 30, 2022": ("day", "2022-09-30", False, None), "30 September 2022": ("day", "2022-09-30", False, None), "september 3 2022": ("day", "2022-09-03", False, None),
        "September, 2025": ("month", "2025-09", False, None), "MAY 2025": ("month", "2025-05", False, None), "Winter, 2026": ("season", "2026-winter", False, None), "2024 Q3": ("quarter", "2024-Q3", False, None), "2024-q1": ("quarter", "2024-Q1", False, None),
        "September 30, 2022 (Subject to change)": ("day", "2022-09-30", True, None), "March 8, 2025 Pre-Sale -at a Fair-": ("day", "2025-03-08", False, "Pre-Sale -at a Fair-"), "2025-03-08 early": ("day", "2025-03-08", False, "early"),
        "-": ("unknown", None, False, None), "To be determined": ("unknown", None, False, None), "  ": ("unknown", None, False, None), "TBD (subject to change)": ("invalid", None, True, None), None: (None, None, False, None),
        "February 30, 2022": ("invalid", None, False, None), "Sept 3, 2022": ("invalid", None, False, None), "2022-13": ("invalid", None, False, None), "Q5 2022": ("invalid", None, False, None), "May 2022 early": ("invalid", None, False, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", dates.partial_date(F.col("raw")).alias("p"))
    assert {r.raw: tuple(r.p) for r in df.collect()} == cases


def test_canonical_json_and_text(spark):
    assert canon.canonical({"b": 1, "a": [True, None, "é"], "é": {}}) == '{"a":[true,null,"é"],"b":1,"é":{}}'
    with pytest.raises(ValueError):
        canon.canonical({"a": 1.5})
    df = spark.createDataFrame([("ﬁne ABC", "– — -"), ("Plain", "x-y"), (None, None)], "a string, b string")
    got = df.select(canon.search_form(F.col("a")).alias("a"), canon.dash_to_null(F.col("b")).alias("b"), canon.nfc(F.col("a")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("fine abc", None, "ﬁne ABC"), ("plain", "x-y", "Plain"), (None, None, None)]
    assert canon.fill_gaps({"a": None, "b": {"c": 1}, "l": []}, {"a": 2, "b": {"c": 5, "d": 6}, "l": [1]}) == {"a": 2, "b": {"c": 1, "d": 6}, "l": []}


def test_cursors_are_bound_to_their_request():
    c = canon.encode_cursor("/cards", "r1", "name", {"game": "g"}, ["a", None, 3])
    assert canon.decode_cursor(c, "/cards", "r1", "name", {"game": "g"}) == ["a", None, 3]
    for other in (("/cards", "r2", "name", {"game": "g"}), ("/cards", "r1", "name", {})):
        with pytest.raises(ValueError):
            canon.decode_cursor(c, *other)
    with pytest.raises(ValueError):
        canon.decode_cursor("!!", "/cards", "r1", "name", {})
    assert canon.page_limit(None) == 50 and canon.page_limit("100") == 100
    for bad in ("0", "101", "1.5", "-1", ""):
        with pytest.raises(ValueError):
            canon.page_limit(bad)
    assert [canon.backoff_ms(i) for i in (1, 2, 5, 9)] == [500, 1000, 8000, 8000]


PROFILE = {
    "kind": "object",
    "fields": {
        "category": {"kind": "enum", "values": ["unit", "trick"], "required": True}, "power": {"kind": "integer", "nullable": True}, "tags": {"kind": "array", "unique": True, "items": {"kind": "string", "min_length": 1}},
        "rules": {"kind": "object", "fields": {"text": {"kind": "string"}}},
    },
    "when": {"field": "category", "cases": {"unit": {"required": ["power"]}, "trick": {"absent": ["power"]}}},
}


def test_profile_validation(spark):
    cases = {
        '{"category":"unit","power":3,"tags":["b","a","b"]}': ('{"category":"unit","power":3,"tags":["a","b"]}', 0, []),
        '{"category":"unit"}': ('{"category":"unit"}', 0, ["missing_field:$.power"]),
        '{"category":"trick","power":1}': ('{"category":"trick","power":1}', 0, ["inapplicable_field:$.power"]),
        '{"category":"other","power":null}': ('{"power":null}', 1, ["unknown_value:$.category"]),
        '{"power":-1}': ('{"power":null}', 0, ["missing_field:$.category", "wrong_type:$.power"]),
        '{"category":"trick","new":1}': ('{"category":"trick"}', 1, []),
        "nonsense": (None, 0, ["not_json:$"]),
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", profiles.validated(F.col("t"), PROFILE).alias("v")).collect()
    assert {r.t: (r.v.value, len(r.v.warnings), sorted(r.v.diagnostics)) for r in got} == cases


def test_attribute_filters_and_leaves(spark):
    df = spark.createDataFrame([(1, '{"category":"unit","power":3,"tags":["a","b"],"rules":{"text":"x"}}'), (2, '{"category":"trick","power":null}')], "id int, a string")
    at = lambda k, v: [r.id for r in df.where(profiles.attribute_filter(PROFILE, k, v, F.col("a"))).collect()]
    assert at("tags", "b") == [1] and at("power", "3") == [1] and at("power", "null") == [2] and at("rules.text", "x") == [1]
    for k, v in (("category", "other"), ("nothing", "x"), ("category", "null"), ("rules", "x")):
        with pytest.raises(ValueError):
            profiles.attribute_filter(PROFILE, k, v, F.col("a"))
    got = profiles.leaves(df, ["id"], "a").collect()
    assert {(r.id, r.attribute, r.value) for r in got} == {(1, "category", '"unit"'), (1, "power", "3"), (1, "tags", '"a"'), (1, "tags", '"b"'), (1, "rules.text", '"x"'), (2, "category", '"trick"'), (2, "power", "null")}
    record = '{"id":1,"evidence":[1],"sub":{"confidence":2,"k":3},"game_data":{"confidence":4}}'
    assert spark.createDataFrame([(record,)], "r string").select(profiles.consumer_content(F.col("r"))).first()[0] == '{"game_data":{"confidence":4},"id":1,"sub":{"k":3}}'


def test_leaves_are_dealt_out_once_or_not_at_all(spark, tmp_path):
    from cartulary.plans.registry import QUERIES

    df = spark.createDataFrame([(1, '{"t":["a","a"]}'), (1, '{"t":["a"]}')], "id int, a string")
    assert profiles.leaves(df, ["id"], "a").collect() == [(1, "t", '"a"')] and profiles.leaves(df, ["id"], "a", distinct=False).count() == 3
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(profiles.leaves(df, ["id"], "a")).count("Exchange") == 1
    spark.createDataFrame([(1, "c#1", 2, "S")] * 2, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["q_nested_leaves"](spark, str(tmp_path))
    assert found.count() == 10 and "Aggregate" not in plan(found)  # its SQL keeps repeated customers


def test_archives(spark, tmp_path):
    import gzip

    path = tmp_path / "cards.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write('{"id":"a","name":"A","layout":"normal","finishes":["foil","plain","foil"]}\n\n{"id":"b","name":"B","layout":"token","finishes":["foil"]}\n{"id":"c","name":"C","layout":"normal","finishes":[]}\n')
    lines = archives.read_json_lines(spark, str(path))
    got = archives.per_finish(lines, "record", ["path"]).select("source_id", "outcome", "finish").collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([("a", "observed", "foil"), ("a", "observed", "plain"), ("b", "excluded", None), ("c", "review", None)], key=repr)
    assert archives.within_archive_limits(lines).first().n_records == 3
    with pytest.raises(Exception, match="record over the limit"):
        archives.read_json_lines(spark, str(path), record_bytes=50).collect()
    pages = spark.createDataFrame([(1, '{"data":{"cards":[{"n":1},{"n":2}]}}'), (2, "{}")], "p int, j string")
    assert [(r.p, r.ordinal, r.record) for r in archives.container_records(pages, "j", "$.data.cards", ["p"]).collect()] == [(1, 0, '{"n":1}'), (1, 1, '{"n":2}')]
    snap = archives.read_snapshots(spark, str(tmp_path))
    assert archives.changed_only(snap, snap.select("sha256"), "sha256").count() == 0


def test_html_records(spark):
    df = spark.createDataFrame([(1, "<li>one <b>bold</b></li><li>two &amp; three</li>"), (2, None), (3, "<li>" * 40_000)], "id int, h string")
    got = {(r.id, r.ordinal, r.record, r.failure) for r in html.records(df, "id", "h", "li").collect()}
    assert got == {(1, 0, "one bold", None), (1, 1, "two & three", None), (3, None, None, "too many tags")}


def test_errata_and_withdrawals(spark):
    rows = [("c1", None, "e1", "old"), ("c1", "2024-01-01", "e2", "new"), ("c1", "2030-01-01", "e3", "future"), ("c2", "2024-01-01", "e4", "x"), ("c2", "2024-01-01", "e5", "y"), ("c3", "2030-01-01", "e6", "z")]
    got = {r.card: (r.id, r.value, r.n_in_force, r.conflict) for r in reconcile.effective_errata(spark.createDataFrame(rows, "card string, eff string, id string, value string"), ["card"], "2025-01-01", "eff", "id", "value").collect()}
    assert got == {"c1": ("e2", "new", 2, False), "c2": ("e5", "y", 2, True)}
    prior = spark.createDataFrame([("a", "withdrawn", "2024-01-01")], "entity string, state string, effective_at string")
    cases = [("a", "withdrawn", "2024-01-01", False), ("a", "reinstated", "2024-02-01", False), ("a", "reinstated", "2024-01-01", True), ("a", "withdrawn", "2025-01-01", True), ("b", "reinstated", "2024-01-01", True), ("b", "withdrawn", "2024-01-01", False)]
    got = reconcile.withdrawal_conflicts(spark.createDataFrame([c[:3] for c in cases], prior.schema), prior, "entity").collect()
    assert sorted(tuple(r) for r in got) == sorted(cases)


def test_text_parts_join_to_the_text(spark):
    text = "añ😀" * 5000
    parts = reconcile.text_parts(spark.createDataFrame([(1, text), (2, "short")], "k int, t string"), "k", "t", 1000)
    assert "".join(r.part for r in parts.orderBy("ordinal").collect()) == text


def test_pacing_in_batch_and_as_a_stream(spark, tmp_path):
    statuses = {3: None, 17: 429, 20: 500, 22: 404}
    rows = [("h", i, statuses.get(i % 29 if i < 40 else 0, 200), None if i == 7 else 9000 if i == 12 else 100 + i, 500 if i == 22 else None) for i in range(100)]
    rows += [("g", i, 200, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "host string, at bigint, status int, latency_ms bigint, retry_after_ms bigint")
    want = {r.host: tuple(r) for r in pacing.fold(df, "host", ["at"]).collect()}
    for k in range(4):
        df.where(f"at div 25 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = pacing.follow(stream, "host", ["at"]).writeStream.format("memory").queryName("paced").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    last = {}
    for r in spark.table("paced").collect():
        last[r.host] = max(last.get(r.host, tuple(r)), tuple(r), key=lambda x: x[1])
    assert last["g"] == want["g"] == ("g", 3, 500, 8, 0, None, 0, 0)
    assert last["h"] == want["h"] and want["h"][1] == 100 and want["h"][6:] == (5, 3)


def test_pacing_steps(spark):
    def after(*signals):
        df = spark.createDataFrame([("h", i, *x) for i, x in enumerate(signals)], "host string, at bigint, status int, latency_ms bigint, retry_after_ms bigint")
        return tuple(pacing.fold(df, "host", ["at"], pacing.Policy(0, 4000, 2)).first())[2:]

    ok = (200, 100, None)
    assert after(ok) == (0, 2, 0, 100, 0, 0)  # at its fastest nothing is counted
    assert after(ok, (429, 50, 1000)) == (250, 1, 0, 100, 1, 0)
    assert after(ok, (200, 1100, None)) == (0, 2, 0, 300, 0, 0)  # four times the average, but not a second more
    assert after(ok, (200, 1101, None)) == (250, 1, 0, 300, 1, 0)
    assert after((503, 10, None), (500, 10, None), (404, 10, None)) == (250, 1, 1, 10, 1, 0)  # a server's other error is neutral
    assert after((None, 10, None), *[ok] * 20) == (0, 2, 0, 100, 1, 1)
    declared = spark.createDataFrame([("a", "asset", 100, 4000, 8), ("a", "asset", 200, 2000, 4), ("b", "asset", 1, 2, 8), ("b", "page", 1, 3, 8)], "host string, kind string, floor_ms int, ceiling_ms int, concurrency int")
    assert sorted(tuple(r) for r in pacing.policies(declared).collect()) == [("a", "asset", 200, 4000, 4), ("b", "page", 1, 3, 1)]


def test_run_control(spark):
    events = spark.createDataFrame([(1, 1, "new"), (1, 2, "running"), (1, 3, "done"), (1, 4, "running")], "run int, seq int, state string")
    legal = [("new", "running"), ("running", "done")]
    assert [r.illegal for r in control.transitions(events, "run", ["seq"], "state", legal).orderBy("seq").collect()] == [False, False, True]
    assert control.current(events, "run", ["seq"], ["state"]).first().state == "running"


def test_folds_hold_no_key_whole(spark):
    rows = [("hot" if i % 3 else f"k{i}", i * 7919 % 3000, None if i == 5 else f"part {i} é", 200, i % 90, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, line string, status int, latency_ms bigint, retry_after_ms bigint").repartition(5)
    made = [evidence.chained_digest(df, ["k"], ["n"], "line"), evidence.reassemble(df, "k", "n", "line"), pacing.fold(df, "k", ["n"])]
    for found in made:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Sort" in plan and "MapInArrow" in plan
    hot = [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == "hot"]
    body = "\n".join(x for x in hot if x is not None).encode()
    chain, parts, paced = ({r[0]: tuple(r)[1:] for r in found.collect()} for found in made)
    # Of the 1,999 parts that are not null; the line feeds between them do not count.
    assert chain["hot"] == (2000, None) and parts["hot"] == (2000, len(body) - 1998, hashlib.sha256(body).hexdigest())
    assert chain["k3"] == (1, hashlib.sha256("part 3 é".encode()).hexdigest()) and len(chain) == len(parts) == len(paced) == 1001
    assert paced["hot"][0] == 2000


def test_prefixes_without_case_and_diacritics(spark):
    rows = spark.createDataFrame([(0, "Pokémon Élite Box"), (1, "POKEMON elite"), (2, "Pokémon set"), (3, "spoke, mon"), (4, None), (5, "")], "i int, t string")
    found = lambda *p: [r.i for r in rows.where(search.prefix_and(F.col("t"), p)).orderBy("i").collect()]
    assert found("poke") == found("POKÉ") == [0, 1, 2] and found("pok", "elit") == [0, 1] and found("mon") == [3]
