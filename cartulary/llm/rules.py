"""Quality rules with adaptive thresholds.

Each text gives counts; ratios of them are judged against thresholds of its
(lang, source) group in place of fixed cutoffs.  A threshold is a fence: the
upper quartile plus FENCE times the distance of the quartiles (a least distance
is set for each ratio, so that a group of alike texts doesn't lose any).  The
quartiles come from quantile sketches that merge: they are built for each group
in each task, merged after the shuffle, and so a hot group costs no more than a
few kilobytes a task.  A group's quartiles are averaged with its language's,
which count as PRIOR texts, and these with those of all texts in the same way:
a small group leans on its language, and no size makes a jump.

Cases: a null text has no words and fails the base rules, as does every text
of fewer than 50 words.  Null lang and source are groups like any other.  With
no text that passes the base rules nothing is kept.  Rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, map_texts

LEAST_WORDS = 50
MOST_REPEATED = 50  # in 100 words
#: Texts that a group's language, and all texts for a language, count as.
PRIOR = 200
FENCE = 3.0
ACCURACY = 10_000
#: Ratio, the least distance of quartiles that counts, and whether low values fail too.
RATIOS = {
    "word_length": ("word_chars / n_words", 0.5, True),
    "symbol_share": ("n_symbols / n_words", 0.05, False),
    "dup_line_share": ("n_dup_lines / n_words", 0.02, False),
    "repeat_share": ("n_repeat_words / n_words", 0.12, False),
}

_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first of them too."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    k = len(number)
    if k < 1 << 20:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # number the pairs first
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * (len(pairs) + 1) + pairs[1:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out = np.zeros(n, bool)
    for i in range(3):
        out[i : i + len(twice)] |= twice
    return int(out.sum())


def _counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    data = text or b""
    words = data.split()
    body = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((body & 0xC0) != 0x80).sum())
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, and the counts NAMES of each text."""

    def work(texts):
        return dict(zip(NAMES, (pa.array(x, pa.int64()) for x in zip(*map(_counts, texts), strict=True)), strict=True))

    return map_texts(docs, work, [(n, "bigint") for n in NAMES], keep, text)


def _fences() -> list[Column]:
    out = [F.count("*").alias("n")]
    for name in RATIOS:
        out.append(F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(f"q_{name}"))
    return out


def thresholds(good: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n and the quartiles q_* of the ratios: for each (lang, source), each lang, and all."""
    return good.groupBy("lang", "source").agg(*_fences()), good.groupBy("lang").agg(*_fences()), good.agg(*_fences())


def _blended(own: str, quartile: str, i: int, above: Column, prior: int) -> Column:
    """The group's quartile and above, weighted by the group's texts and prior; above alone for a group of none."""
    n = F.coalesce(F.col(f"{own}.n"), F.lit(0))
    return (n * F.coalesce(F.col(f"{own}.{quartile}")[i], F.lit(0.0)) + prior * above) / (n + prior)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed, failed (names of the ratios beyond their fence), kept, for each row."""
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc_id"), (lang, "lang"), (source, "source"), (text, "text"))])
    base = counts(named, ["doc_id", "lang", "source"])
    base = base.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    base = cut(base.withColumns({n: F.expr(f"if(n_words = 0, 0D, {e})") for n, (e, _, _) in RATIOS.items()}))
    groups, langs, every = thresholds(base.where("not base_failed"))
    names = [f"q_{n}" for n in RATIOS]
    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.struct("n", *names).alias("g"))
    s = langs.select(F.col("lang").alias("s_lang"), F.struct("n", *names).alias("s"))
    whole = every.first()  # one row
    joined = base.join(g, base["lang"].eqNullSafe(g["g_lang"]) & base["source"].eqNullSafe(g["g_source"]), "left")
    joined = joined.join(s, joined["lang"].eqNullSafe(s["s_lang"]), "left")
    failed = []
    for name, (_, least, both) in RATIOS.items():
        q = whole[f"q_{name}"] or [0.0, 0.0]  # without any good text, no text is kept whatever its ratios
        lo, hi = (_blended("g", f"q_{name}", i, _blended("s", f"q_{name}", i, F.lit(q[i]), prior), prior) for i in (0, 1))
        reach = FENCE * F.greatest(hi - lo, F.lit(least))
        beyond = F.col(name) > hi + reach
        failed.append(F.when(beyond | (F.col(name) < lo - reach) if both else beyond, F.lit(name)))
    joined = joined.withColumn("failed", F.array_compact(F.array(*failed)))
    return joined.select("doc_id", *NAMES, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
