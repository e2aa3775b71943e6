import zlib

import numpy as np
import pytest

from cartulary.llm import quality, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_quality_classifier(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.95
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_labels_of_held_out_rows_do_not_count(spark, messy):
    rows = messy.where("doc_id is not null")
    ids = [r.doc_id for r in rows.select("doc_id").distinct().collect()]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip if i in held else 0), 3) for i in ids], "doc_id bigint, quality int, score int")
        scores.append(quality.classify(rows, labels).groupBy("doc_id").agg({"score": "sum"}).orderBy("doc_id").toPandas())
    assert scores[0].equals(scores[1])


def test_density_difference_by_definition():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(0, 1, (200, d)), rng.normal(0.5, 2, (150, d))]
    model = quality.Model(0.5, np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2))
    for c in (0, 1):
        cov = np.cov(x[c].T)
        factor = np.linalg.cholesky(cov)
        model.means[c], model.whiten[c] = x[c].mean(axis=0), np.linalg.inv(factor)
        model.constant[c] = -np.log(np.diag(factor)).sum()
    p = rng.normal(0, 1, d)

    def density(c):
        cov = np.cov(x[c].T)
        z = p - x[c].mean(axis=0)
        return -0.5 * (np.linalg.slogdet(cov)[1] + z @ np.linalg.solve(cov, z))

    assert model.difference(p[None, :])[0] == pytest.approx(density(1) - density(0))


def plain_scores(rows, labels):
    """The scores by plain numpy over all rows at once: class covariances, their shrinkage, log-densities, and a sigmoid by gradient descent."""
    x = {d: np.array(quality.statistics(None if t is None else t.encode())) for d, t in rows.items()}
    known = [(x[d], y) for d, y in labels if d in x and y in (0, 1) and zlib.crc32(str(d).encode()) % 5]
    every = np.array([v for v, _ in known])
    spread = np.maximum(every.var(axis=0), 1e-9)
    parts = []
    for c in (0, 1):
        own = np.array([v for v, y in known if y == c])
        cov = np.cov(own.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + np.diag(0.01 * spread)
        parts.append((len(own), own.mean(axis=0), cov))

    def difference(v):
        got = []
        for n, mean, cov in parts:
            z = v - mean
            got.append(np.log(n) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * z @ np.linalg.solve(cov, z))
        return min(200.0, max(-200.0, got[1] - got[0]))

    # The differences go by the middle of their bin, 400 of them from -200 to 200.
    z = np.array([min(399, int((difference(v) + 200) / 400 * 400)) + 0.5 - 200 for v, _ in known])
    y = np.array([y for _, y in known])
    a, b = 1.0, 0.0  # of (z / 10), by plain steps with the small penalty
    for _ in range(400_000):
        p = 1 / (1 + np.exp(-np.clip(a * z / 10 + b, -30, 30)))
        da, db = ((p - y) * z / 10).sum() + 0.01 * a, (p - y).sum() + 0.01 * b
        a, b = a - 0.002 * da, b - 0.002 * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return {d: 1 / (1 + np.exp(-np.clip(max(a / 10, 1e-3) * difference(v) + b, -500, 500))) for d, v in x.items()}


def test_scores_against_plain_numpy(spark):
    """Repeated labels and one very long text are in it; some labels are of no document, or no class."""
    rng = np.random.default_rng(5)
    rows = {}
    for i in range(160):
        n = int(rng.integers(20, 120))
        rows[i] = " ".join(f"{'$#' if i % 3 == 0 and rng.random() < 0.3 else ''}w{int(rng.integers(40 + 300 * (i % 2)))}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))
    rows |= {200: None, 201: "", 202: "long " * 5000 + " ".join(f"u{i}" for i in range(20_000))}
    labels = [(i, int((i % 3 != 0) ^ (rng.random() < 0.1))) for i in range(150)] + [(7, 1), (7, 1), (8, 5), (9, None), (999, 1), (202, 1)]
    got = quality.classify(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    want = plain_scores(rows, labels)
    assert len(got) == len(want) == 163
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=2e-4), r
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_odd_rows_and_missing_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.classify(messy, none)
    assert got.count() == messy.count() and got.where("score <> 0.5").count() == 0
    some = spark.createDataFrame([(100, None), (101, 1), (None, 1), (102, 5)], "doc_id bigint, quality int")
    assert quality.classify(messy, some).where("score is null").count() == 0
    assert quality.classify(empty, none).count() == 0
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.FEATURES)
