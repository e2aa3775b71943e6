import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartulary.llm import language, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, d).toPandas()
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert got.rejected.mean() < 0.01 and got.score.between(0, 1).all()


def invented(n_languages: int, rows: int, seed: int = 4, letters: str = "abcdefghijklmnopqrstuvwxyzéñßøłğ") -> list[tuple]:
    """Texts of invented languages: words of syllables of their own, over shared letters."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n_languages):
        syllables = ["".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(40)]
        for _ in range(rows):
            words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(15, 80))]
            out.append((len(out), " ".join(words), f"l{k:02d}"))
    return out


@pytest.mark.parametrize("languages", [6, 30])
def test_held_out_accuracy_on_other_corpora(spark, languages):
    """With fewer and with more languages than the embeddings have dimensions."""
    docs = spark.createDataFrame(invented(languages, 120), "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert (model.layer is None) == (languages <= language.DIM) and len(model.languages) == languages
    got = language.identify(docs, model, ["doc_id", "lang"]).where(language.is_held_out()).toPandas()
    assert len(got) > 20 * languages and (got.lang == got["__lang"]).mean() >= 0.97


def naive(model: language.Model, text: str) -> tuple[str, float]:
    """By the definition: every n-gram of each word's bytes with a blank on one side or none, one by one; their average; softmax."""
    data = text.encode().translate(language._FOLD)
    sums, n = [0.0] * model.table.shape[1], 0
    for word in data.split():
        word = b" " + word + b" "
        for size in range(1, 5):
            for i in range(len(word) - size + 1):
                gram = word[i : i + size]  # a blank may be its first or its last byte
                if not (gram[:1] == b" " and gram[-1:] == b" "):
                    bucket = ((int.from_bytes(gram, "big") + (size << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 15)
                    sums = [s + float(x) for s, x in zip(sums, model.table[bucket], strict=True)]
                    n += 1
    mean = np.array(sums) / max(n, 1)
    z = (mean if model.layer is None else mean @ model.layer) + model.bias
    p = [math.exp(x - max(z)) for x in z]
    k = p.index(max(p))
    return model.languages[k], p[k] / sum(p)


@pytest.mark.parametrize("languages", [3, 20])
def test_predictions_against_the_definition(spark, messy, languages):
    model = language.train([(t.encode(), y) for _, t, y in invented(languages, 20)])
    rows = {r.doc_id: r for r in language.identify(messy, model, ["doc_id", "text"]).where("text is not null and doc_id is not null").collect()}
    assert len(rows) > 60
    for r in rows.values():
        if r["__lang"] != language.UNDETERMINED:
            lang, p = naive(model, r.text)
            assert r["__lang"] == lang and abs(r["__score"] - p) < 1e-5


def test_stretches_and_groups_agree():
    """A text alone, in a group, and in stretches: the same n-grams, those at the seams too."""
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], rng.normal(0, 1, (language.BUCKETS, 2)).astype(np.float32), np.zeros(2), 0.1)
    texts = [b"hello there", b"", b"\xc3\xa9t\xc3\xa9 d", b"x" * 10, b"12 34"]
    one = [model.predict([t]) for t in texts]
    many = model.predict(texts)
    assert [int(g[0]) for g, _ in one] == many[0].tolist()
    assert np.allclose([p[0] for _, p in one], many[1])
    long = "ein Wörtchen für sich ".encode() * 30_000 + b"end"
    parts = list(language._groups([long], 1 << 18))
    assert len(parts) == 3
    split = np.concatenate([b[at < end] for _, _, x, end in parts for b, at in [language._buckets(x)]])
    assert np.array_equal(np.sort(split), np.sort(language.grams(long)))


def test_ngrams_stay_in_words():
    assert len(language.grams(b"ab")) == 7  # a, b, ab, and with the word's edges: _a, b_, _ab, ab_
    assert len(language.grams(b"ab cd")) == 14
    assert len(language.grams(b"")) == 0 and len(language.grams(b"1 2")) == 0
    assert sorted(language.grams(b"AB")) == sorted(language.grams(b"ab"))


def test_the_sample_at_any_size(spark):
    """The rows of the smallest hashes of each language, whatever the counts; long texts and repeated rows too."""
    for n in (1, 1000, 10**9, 10**13):
        low = language._part_of_hashes(n, 50) + (1 << 63)
        assert low == min((1 << 64) - 1, (160 << 64) // n) and low * n >> 64 >= min(n - 1, 159)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("concat('text number ', id)").alias("text"), F.expr("if(id < 5, 'rare', if(id % 2 = 0, 'a', 'b'))").alias("lang"))
    docs = docs.unionByName(spark.range(400).selectExpr("7L as doc_id", "'said again' as text", "'a' as lang"))  # a third of one row
    docs = docs.unionByName(spark.createDataFrame([(i, "palabra " * 20_000, "long") for i in range(3, 9)], docs.schema))
    got = language.training_sample(docs, "text", "lang", rows=200)
    by = {y: [t for t, x in got if x == y] for y in ("a", "b", "rare", "long")}
    assert [len(by[y]) for y in ("a", "b")] == [50, 50] and 1 <= len(by["rare"]) <= 5 and 1 <= len(by["long"]) <= 6
    assert all(len(t) == language.STRETCH for t in by["long"]) and by["a"].count(b"said again") <= 1
    held = docs.where(~language.is_held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).distinct().toPandas()
    for y in ("a", "b"):
        assert {t.decode() for t in by[y]} == set(held[held.lang == y].nsmallest(50, "h").text)
    model = language.fit(docs)
    assert "long" in model.languages  # a language of long texts only is learned


def test_many_languages(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('w', id % 600, ' x') as text", "concat('l', id % 600) as lang")
    got = language.training_sample(docs, "text", "lang", rows=100, least=2)
    assert len({y for _, y in got}) == 600 and len(got) <= 1200


def test_odd_rows(spark, messy, empty):
    model = language.fit(messy)
    got = {(r.doc_id, r["__lang"], r["__rejected"]) for r in language.identify(messy, model, messy.columns).collect()}
    for i in (700, 701, 702, 703, 707, 709):  # null, empty, blank, no letters
        assert (i, language.UNDETERMINED, True) in got
    assert {x[1] for x in got} <= {"en", "de", language.UNDETERMINED}
    assert language.identify(messy, model, messy.columns).count() == messy.count()
    assert language.fit(empty) is None
    assert language.identify(messy, None, ["doc_id"]).where("__lang <> 'und'").count() == 0
    assert language.identify(empty, model, ["doc_id"]).count() == 0


def test_batches_of_texts_are_bounded(spark):
    """By Spark's own limit a batch of these rows has 20 MB; executors and workers hold several."""
    from cartulary.llm import common

    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "'en' AS lang")
    spark.conf.unset(common.BATCH_LIMIT)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    judged = language.identify(docs, None, ["doc_id", "text"])
    assert judged.select("text").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * common.BATCH_BYTES
    assert judged.where("__lang = 'und'").count() == 2000
    spark.conf.set(common.BATCH_LIMIT, "12345")  # a session's own limit stays
    language.identify(docs, None, ["doc_id"])
    assert spark.conf.get(common.BATCH_LIMIT) in ("12345", "12345b")
    spark.conf.unset(common.BATCH_LIMIT)
