"""Quality classifier: a regularised quadratic discriminant over text statistics.

Each text gives a short vector of transformed statistics.  A class has a mean
and a covariance, shrunk towards its diagonal; both come from sums (count, sum,
sum of products) that are added up over all labelled rows.  The score is the
difference of the two Mahalanobis log-densities, by Cholesky factors that are
inverted once, put through a sigmoid that is fitted to a histogram of the
training rows' differences.

Cases: a null text counts as empty, and an empty text gets a score like any
other.  Labels other than 0 and 1, and null ones, are left out; a document with
several label rows counts once for each.  If a class has no labelled rows the
score is the share of label 1 (0.5 without labels).  Rows are judged one by one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, is_held_out, map_texts

SHRINKAGE = 0.05
CUT_OFF = 0.3
BINS = 400
MOST_DIFFERENCE = 200.0
FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct", "upper", "punctuation", "symbols", "digits", "non_ascii",
    "top_word", "repeated_pairs", "line_words", "repeated_lines", "packed", "ends",
)

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_STOPS = b".,;:!?"
_SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _STOPS)
_HIGH = bytes(range(0x80, 0x100))
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def _share(data: bytes, of: bytes, n: int) -> float:
    return (len(data) - len(data.translate(None, of))) / n


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of a whole text."""
    data = text or b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    body = b"".join(words)
    size = len(body)
    lengths = np.fromiter(map(len, words), np.float64, n)
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    counts = np.bincount(ids)
    pairs = len(np.unique(ids[:-1] * len(number) + ids[1:])) if n > 1 else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = len(data) - len(data.translate(None, b".!?"))
    root = np.sqrt
    return [
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        len(number) / n**0.9,
        root(_share(body, _UPPER, size)),
        root(_share(body, _STOPS, size)),
        root(_share(body, _SYMBOLS, size)),
        root(_share(body, _DIGITS, size)),
        root(_share(body, _HIGH, size)),
        root(counts.max() / n),
        root(1 - pairs / (n - 1)) if n > 1 else 0.0,
        np.log1p(n / len(lines)),
        root(1 - len(set(lines)) / len(lines)),
        np.log(len(zlib.compress(data, 1)) / len(data)),
        np.log1p(100 * ends / n) / 5,
    ]


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, and x, the statistics of each text."""
    return map_texts(docs, lambda texts: {"x": [statistics(t) for t in texts]}, [("x", "array<double>")], keep, text)


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None  # class x feature
    whiten: np.ndarray | None = None  # class x feature x feature: inverted Cholesky factors
    constant: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log-density under class 1 less that under class 0."""
        if self.means is None:
            return np.zeros(len(x))
        out = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            out.append(self.constant[c] - 0.5 * (z * z).sum(axis=1))
        return np.clip(out[1] - out[0], -MOST_DIFFERENCE, MOST_DIFFERENCE)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES))


def _by_class(rows: DataFrame, work, width: int) -> dict[int, np.ndarray]:
    """Sums over the rows of each class of what work gives for a batch: width numbers."""

    def run(batches):
        for batch in batches:
            y, x = batch.column("y").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
            for c in (0, 1):
                if (y == c).any():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([work(x[y == c]).tolist()], pa.list_(pa.float64()))], names=["y", "v"])

    parts = rows.select("y", "x").mapInArrow(run, "y int, v array<double>").select("y", F.posexplode("v"))
    found = {0: np.zeros(width), 1: np.zeros(width)}
    for r in parts.groupBy("y", "pos").agg(F.sum("col").alias("v")).collect():  # 2 * width rows
        found[r.y][r.pos] = r.v
    return found


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """A model of rows x (statistics) and y (0 or 1)."""
    d = len(FEATURES)

    def moments(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    sums = _by_class(labelled, moments, 1 + d + d * d)
    n = np.array([sums[c][0] for c in (0, 1)])
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Model(prior)
    model = Model(prior, np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2))
    total = sums[0] + sums[1]
    spread = np.maximum(np.diag(total[1 + d :].reshape(d, d)) / total[0] - (total[1 : 1 + d] / total[0]) ** 2, 1e-9)
    for c in (0, 1):
        mean = sums[c][1 : 1 + d] / n[c]
        cov = sums[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + np.diag(0.01 * spread)
        factor = np.linalg.cholesky(cov)
        model.means[c], model.whiten[c] = mean, np.linalg.inv(factor)
        model.constant[c] = np.log(n[c]) - np.log(np.diag(factor)).sum()

    def histogram(x: np.ndarray) -> np.ndarray:
        at = ((model.difference(x) + MOST_DIFFERENCE) / (2 * MOST_DIFFERENCE) * BINS).astype(int)
        return np.bincount(np.clip(at, 0, BINS - 1), minlength=BINS).astype(float)

    bins = _by_class(labelled, histogram, BINS)
    middle = (np.arange(BINS) + 0.5) / BINS * 2 * MOST_DIFFERENCE - MOST_DIFFERENCE
    model.slope, model.shift = _sigmoid_fit(middle, bins[0], bins[1])
    return model


def _sigmoid_fit(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's steps on the penalised log-loss."""
    scale = 10.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta, n = np.array([1.0, 0.0]), zeros + ones
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * p - ones) + 0.01 * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(beta[0] / scale, 1e-3), beta[1]


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut_off: float = CUT_OFF) -> DataFrame:
    """doc_id, held_out, score, predicted, for each row; held-out rows are not learned from."""
    rows = cut(features(docs, [doc_id], text).withColumnRenamed(doc_id, "doc_id"))
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    labelled = rows.where(~is_held_out()).join(known, "doc_id").select("x", "y")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))

    def run(batches):
        for batch in batches:
            score = model.value.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= cut_off, 1).otherwise(0).alias("predicted"))
