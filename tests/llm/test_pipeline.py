"""The pipeline against the same decisions by loops, over a folder of awkward documents."""

import hashlib

import pytest

import corpus_pipeline
from cartulary.llm import contamination, language, lines
from tests.llm import test_op5_simhash as op5
from tests.llm import test_op8_lines as op8

ITEM = "this benchmark passage has more than ten words in a row to be found"


@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    extra = spark.createDataFrame([(950, f"w1 w2 w3 {ITEM} w4 w5", "en", "s0", 1, 0.5, "x", 7, "k"), (951, " ".join(f"w{i}" for i in range(70)), "en", "s0", 1, 0.5, "x", 7, "k")], messy.schema)
    messy.unionAll(extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def one_of_each_group(rows):
    """Of each group of near-duplicates the row that stays, by loops."""
    groups: dict = {}
    for i, _, c in op5.component_of([(i, op5.fingerprint(r.text)) for i, r in enumerate(rows)]):
        groups.setdefault(c, []).append(rows[i])

    def order(r):
        digest = "none" if r.text is None else hashlib.md5(r.text.encode()).hexdigest()
        return r.doc_id is None, r.doc_id or 0, f"{r.doc_id}:{digest}"

    return [min(g, key=order) for g in groups.values()]


def test_near_duplicates_go_by_row(spark, messy, empty):
    key = lambda r: repr(tuple(r))
    alone = " ".join(f"x{i}" for i in range(40))
    extra = spark.createDataFrame([(i, t, "en", "s0", 1, 0.5, "x", 7, "k") for i, t in [(None, alone), (None, alone), (902, " ".join(reversed(alone.split()))), (100, alone + " y"), (100, alone + " y")]], messy.schema)
    rows = messy.unionAll(extra)
    got, want = corpus_pipeline.drop_near_duplicates(spark, rows, ""), one_of_each_group(rows.collect())
    assert got.columns == messy.columns and sorted(map(key, got.collect())) == sorted(map(key, want))
    # A copy goes although another text has its doc_id, and one row of copies without an id stays.
    assert len(want) == len({op5.fingerprint(r.text) for r in want}) and any(r.doc_id is None for r in want)
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        key = lambda r: repr(tuple(r))
        if k == 0:
            model = language.fit(spark.createDataFrame(before, out.schema))
            judged = language.identify(spark.createDataFrame(before, out.schema), model, columns).where("not __rejected").count()
            assert len(after) == judged and all(r.text and any(c.isalpha() for c in r.text) for r in after)
            assert {key(r) for r in after} <= {key(r) for r in before}
        if k == 1:
            tkeys = {r.text: r.h for r in spark.createDataFrame(before, docs.schema).selectExpr("text", "xxhash64(text) h").collect()}
            want = [(d, t) for d, n, gone, t in op8.brute([(r.doc_id, tkeys[r.text], r.text) for r in before], 1) if not gone or gone < n]
            assert sorted([(r.doc_id, r.text) for r in after], key=repr) == sorted(want, key=repr)
        if k == 2:
            assert sorted(map(key, after)) == sorted(map(key, one_of_each_group(before)))
        if k == 3:
            clean = [r for r in before if ITEM not in r.text]
            assert len(clean) < len(before) and sorted(map(key, after)) == sorted(map(key, clean))
        if k == 4:
            assert sum(r.start == 0 for r in after) == len(before)
            assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).where("start = 0").count() > 30


def test_words_of_items():
    assert contamination.words_of(ITEM.upper().encode()) == ITEM.encode().split()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_empty_tables_and_rows_without_ids_or_texts(spark, tmp_path, number):
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame([("i", None), ("j", "one two three four five six seven eight nine ten")], "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, str(tmp_path)).count() == 0
    bare = spark.createDataFrame([(None,) * 9, (None, "", *(None,) * 7), (5, None, *(None,) * 7)], SCHEMA)
    got = stage(spark, bare, str(tmp_path))
    assert got.count() == [0, 3, 1, 3, 3][number]
    assert number == 4 or got.columns == bare.columns
