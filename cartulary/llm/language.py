"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams (1 to 4 bytes,
within words, hashed to a fixed number of buckets); a linear layer and softmax
give the languages.  Embeddings and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows, on stretches of varied
length.  Part of the sample calibrates: a temperature for the probabilities
and the score below which a prediction is rejected.  As averaging and the layer
are linear, they are folded into one table for prediction, which runs over
whole texts.

The sample: of each language the rows with the smallest hashes of id and text,
SAMPLE_ROWS divided by the languages but LEAST_ROWS at least, so it grows with
the languages only; a row gives its text or, of a longer one, a stretch of
STRETCH bytes from anywhere in it.  Repeated rows count once.

Cases: a null text, or one without a letter, is `und` with score 0, rejected.
Rows with null lang are not learned from.  With no labelled row every text is
`und`; with one language only, every text with a letter gets it.  Rows are
judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.llm.common import is_held_out, map_texts

UNDETERMINED = "und"
#: Rows of the training sample in all, and of each language at least.
SAMPLE_ROWS = 4000
LEAST_ROWS = 20
#: Bytes of a text that the sample holds at most.
STRETCH = 1 << 13
EPOCHS = 4
BUCKETS = 1 << 15
DIM = 16
#: Share of correct calibration predictions that may be rejected, and the most the threshold may be.
FALSE_REJECTION = 0.001
MOST_THRESHOLD = 0.5

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Bytes as they count: letters A-Z as a-z, other ASCII as a blank.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def grams(data: bytes) -> np.ndarray:
    """Bucket numbers of the n-grams of 1 to 4 bytes, not across more than a word's edge."""
    x = np.frombuffer(b" " + data.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    return _buckets(x)[0]


def _buckets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and end positions of the n-grams of folded bytes x."""
    out, ends = [], []
    blank = x == 0x20
    code = np.zeros(len(x), np.uint32)
    bad = np.zeros(len(x), bool)
    for n in range(1, 5):
        m = len(x) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | x[n - 1 :]
        # A blank may stand first or last only, and not alone.
        if n == 1:
            ok = ~blank
        else:
            if n > 2:
                bad = bad[:m] | blank[n - 2 : n - 2 + m]
            else:
                bad = np.zeros(m, bool)
            ok = ~bad & ~(blank[:m] & blank[n - 1 :]) if n > 2 else ~(blank[:m] & blank[1:])
        at = np.flatnonzero(ok)
        key = code[at].astype(np.uint64) + np.uint64(n << 40)
        out.append(((key * _SPREAD) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int32))
        ends.append(at)
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(ends)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: a bucket's share of the logits; or BUCKETS x DIM, with a layer
    bias: np.ndarray
    threshold: float
    layer: np.ndarray | None = None  # DIM x languages: only where there are more languages than dimensions

    def logits(self, texts: list[bytes]) -> np.ndarray:
        n, width = len(texts), self.table.shape[1]
        sums, counts = np.zeros((n, width)), np.zeros(n)
        # Short texts together; long ones in stretches.
        for first, last, x, begins in _groups(texts):
            bucket, at = _buckets(x)
            if last - first == 1:
                own = at < begins  # those that begin later belong to the next stretch
                sums[first] += self.table[bucket[own]].sum(axis=0)
                counts[first] += int(own.sum())
            else:
                edges = np.cumsum([len(t) + 2 for t in texts[first:last]])
                doc = np.searchsorted(edges, at, "right")
                counts[first:last] += np.bincount(doc, minlength=last - first)
                for j in range(width):
                    sums[first:last, j] += np.bincount(doc, self.table[bucket, j], minlength=last - first)
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its probability, for each text."""
        return _likeliest(self.logits(texts))


def _likeliest(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def _folded(texts: list[bytes]) -> np.ndarray:
    """Each text between blanks of its own, so that no n-gram spans two."""
    data = b"".join(x for t in texts for x in (b" ", t, b" "))
    return np.frombuffer(data.translate(_FOLD), np.uint8).astype(np.uint32)


def _groups(texts: list[bytes], limit: int = 1 << 18):
    """(first, last, folded bytes, end): texts together, or stretches of one, with the bytes that n-grams from before end reach into."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > limit:
            if i > first:
                yield first, i, (x := _folded(texts[first:i])), len(x)
            whole = b" " + t + b" "
            for s in range(0, len(whole), limit):
                part = whole[s : s + limit + 3].translate(_FOLD)
                yield i, i + 1, np.frombuffer(part, np.uint8).astype(np.uint32), limit
            first, size = i + 1, 0
        else:
            size += len(t)
            if size > limit:
                yield first, i + 1, (x := _folded(texts[first : i + 1])), len(x)
                first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts), (x := _folded(texts[first:])), len(x)


def _part_of_hashes(count: int, wanted: int) -> int:
    """The signed 64-bit hash below which some 2 * wanted + 60 of count different ones lie."""
    return -(1 << 63) + min((1 << 64) - 1, ((2 * wanted + 60) << 64) // max(count, 1))


def training_sample(docs: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", least: int = LEAST_ROWS, stretch: int = STRETCH) -> list[tuple[bytes, str]]:
    """Stretches of the labelled texts with the smallest hashes, as many of each language.

    The languages' numbers of different rows (a mergeable sketch) give a hash
    that somewhat more rows than needed lie below; of those the smallest are
    taken.  What the driver gets is bounded by the languages and rows.
    """
    columns = {"lang": F.col(f"`{lang}`").cast("string"), "text": F.col(f"`{text}`").cast("binary")}
    own = docs.where(~is_held_out(doc_id)).select(*[c.alias(n) for n, c in columns.items()], F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"))
    own = own.where((F.octet_length("text") > 0) & F.col("lang").isNotNull())
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return []
    share = max(least, rows // len(counts))
    # A row for each language, as in the model: small enough to broadcast.
    limits = docs.sparkSession.createDataFrame([(r.lang, _part_of_hashes(r.n, share)) for r in counts], "lang string, most bigint")
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.octet_length("text") - stretch + 1, F.lit(1))).cast("int") + 1
    some = own.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "h", F.substring("text", begin, F.lit(stretch)).alias("part"))
    some = some.groupBy("lang", "h").agg(F.min("part").alias("part"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    picked = some.withColumn("place", place).where(F.col("place") <= share).select("lang", "part", "h").collect()
    picked.sort(key=lambda r: (r.h, r.lang))
    return [(bytes(r.part), r.lang) for r in picked]


def _descend(rows: list[tuple], emb: np.ndarray, layer: np.ndarray, bias: np.ndarray, rng: np.random.Generator, epochs: int, rate: float) -> None:
    """Stochastic gradient descent in place; rows: buckets, their weights, number of the language."""
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(rows)):
            bucket, weight, y = rows[i]
            own = emb[bucket]
            h = weight @ own
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # The average spreads a gradient thin over the buckets; a larger step makes up for it.
            own -= weight[:, None] * (8 * step * (layer @ p))
            emb[bucket] = own
            layer -= step * (h[:, None] * p)
            bias -= np.float32(0.05) * step * p


def train(sample: list[tuple[bytes, str]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> Model | None:
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in sample})
    number = {y: i for i, y in enumerate(languages)}
    k = len(languages)
    fit = [s for i, s in enumerate(sample) if i % 5]
    check = [s for i, s in enumerate(sample) if not i % 5] or fit
    fit = fit or sample
    rows = []
    for data, y in fit:
        for _ in range(2):
            length = int(2 ** rng.uniform(4, 10))
            at = int(rng.integers(0, max(1, len(data) - length)))
            if len(g := grams(data[at : at + length])):
                bucket, count = np.unique(g, return_counts=True)
                rows.append((bucket, (count / len(g)).astype(np.float32), number[y]))
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    _descend(rows, emb, layer, bias, rng, epochs, rate)
    # Folded where that makes the table smaller; the numbers are the same.
    model = Model(languages, emb @ layer, bias, 0.0) if k <= DIM else Model(languages, emb, bias, 0.0, layer)
    logits = model.logits([t for t, _ in check])
    truth = np.array([number[y] for _, y in check])
    # Temperature: the one under which the calibration labels are likeliest.
    best = (-np.inf, 1.0)
    for scale in 2.0 ** np.arange(-2, 3.5, 0.5):
        guess, p = _likeliest(logits * scale)
        likely = np.where(guess == truth, np.log(np.maximum(p, 1e-9)), np.log(np.maximum((1 - p) / max(1, k - 1), 1e-9))).mean()
        best = max(best, (likely, scale))
    model.table, model.bias = (model.table * best[1]).astype(np.float32), model.bias * best[1]
    guess, p = _likeliest(logits * best[1])
    right = p[guess == truth]
    model.threshold = float(min(MOST_THRESHOLD, np.quantile(right, FALSE_REJECTION))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the rows whose id is not held out."""
    return train(training_sample(docs, text, lang, rows, doc_id))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, __lang, __score and __rejected, for each row."""
    rows = docs.withColumn("__letter", F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def work(texts, letters):
        m = shared.value
        ok = np.array(letters, bool)
        out = {"__lang": [UNDETERMINED] * len(texts), "__score": np.zeros(len(texts)), "__rejected": np.ones(len(texts), bool)}
        if m is not None and ok.any():
            at = np.flatnonzero(ok)
            guess, p = m.predict([texts[i] for i in at])
            for i, g in zip(at.tolist(), guess.tolist(), strict=True):
                out["__lang"][i] = m.languages[g]
            out["__score"][at] = p
            out["__rejected"][at] = p < m.threshold
        return out

    return map_texts(rows, work, [("__lang", "string"), ("__score", "double"), ("__rejected", "boolean")], keep, text, also="__letter")
