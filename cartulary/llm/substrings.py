"""Exact substring deduplication by difference-cover anchors.

A difference cover of a period v is a set of residues whose differences give
every residue.  Windows of `window - v + 1` words are hashed only where the
position modulo v is in the cover (6 of 31 positions).  For any two equal
windows of `window` words there is a shift below v that puts both positions on
the cover, so they share an anchor at that shift.  Anchors that two documents
share are extended: every full window that contains such an anchor is hashed
with 128 bits, and a word goes if a full window over it also starts in a
document with a smaller doc_id.

Cases: null and wordless texts have no words and stay as they are; texts
shorter than the window lose nothing.  Rows that share a doc_id don't dedupe
each other, and each is judged by itself.  A row with a null doc_id neither
takes words from others nor loses any.  Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import rolling
from cartulary.llm.common import cut, discard, explode_texts, long_id, stored

WINDOW = 50
PERIOD = 31
#: A perfect difference set of the period.
COVER = (1, 5, 11, 24, 25, 27)

_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def anchor_positions(n_words: int, window: int = WINDOW) -> np.ndarray:
    """The cover positions at which an anchor fits."""
    last = n_words - (window - PERIOD + 1)
    if n_words < window or last < 0:
        return np.zeros(0, np.int64)
    at = np.arange(last + 1)
    return at[_ON_COVER[at % PERIOD]]


def _anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = rolling.word_hashes(words)
    at = anchor_positions(len(words), window)
    return at, rolling.Windows(hashes).at(at, window - PERIOD + 1), hashes


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, anchor: each document's distinct anchors."""

    def work(texts, ids):
        doc_ids, tkeys = (x.to_numpy(zero_copy_only=False) for x in ids)
        out, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            words = t.split()
            if len(words) >= window:
                out.append(np.unique(_anchors(words, window)[1]).view(np.int64))
                owner.append(np.full(len(out[-1]), i))
        owner = np.concatenate(owner)
        return {"doc_id": doc_ids[owner], "tkey": tkeys[owner], "anchor": np.concatenate(out)}

    return explode_texts(docs, work, "doc_id bigint, tkey bigint, anchor bigint", ["doc_id", "tkey"])


def _candidates(docs: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """doc_id, tkey, anchors: of the texts that are no exact copies, the anchors that another text has too."""
    found, path = stored(anchors(docs, window))  # read twice; texts are gone through once
    shared = found.groupBy("anchor").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")).where("lo < hi").select("anchor")
    # Written apart, so that the join's sides are plain shuffles, of which Spark can split a hot anchor's.
    shared = cut(shared)
    per_doc = found.join(shared, "anchor").groupBy("doc_id", "tkey").agg(F.collect_set("anchor").alias("anchors"))
    candidates = cut(per_doc.join(copies, ["doc_id", "tkey"], "left_anti"))
    discard(docs.sparkSession, path)
    return candidates


def full_windows(docs: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, start, w0, w1: the full windows around the candidates' anchors, with their 128-bit hash."""

    def work(texts, ids):
        doc_ids, tkeys = (x.to_numpy(zero_copy_only=False) for x in ids[:2])
        owner, start, w0, w1 = ([np.zeros(0, np.int64)] for _ in range(4))
        for i, (known, t) in enumerate(zip(ids[2].to_pylist(), texts, strict=True)):
            words = t.split()
            at, keys, hashes = _anchors(words, window)
            at = at[np.isin(keys.view(np.int64), np.array(known, np.int64))]
            # An anchor at p lies in the windows that start from p - (PERIOD - 1) to p.
            starts = np.flatnonzero(rolling.covered(np.maximum(at - (PERIOD - 1), 0), PERIOD, len(words))[: len(words) - window + 1])
            owner.append(np.full(len(starts), i))
            start.append(starts)
            w0.append(rolling.Windows(hashes, 0).at(starts, window).view(np.int64))
            w1.append(rolling.Windows(hashes, 1).at(starts, window).view(np.int64))
        owner = np.concatenate(owner)
        return {"doc_id": doc_ids[owner], "tkey": tkeys[owner], "start": np.concatenate(start), "w0": np.concatenate(w0), "w1": np.concatenate(w1)}

    return explode_texts(docs.join(candidates, ["doc_id", "tkey"]), work, "doc_id bigint, tkey bigint, start bigint, w0 bigint, w1 bigint", ["doc_id", "tkey", "anchors"])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tkey, whole, starts: what each text repeats of earlier documents.

    docs: doc_id, tkey (a hash of the text) and text, none of them null.
    whole: an earlier document has the same text.  Else starts has the word
    positions of the windows that start in an earlier document too.
    """
    texts = docs.select("doc_id", "tkey", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    first = cut(first)  # for a hot text
    copies = cut(texts.join(first, "digest").where("lo < doc_id").select("doc_id", "tkey").distinct())
    candidates = _candidates(docs, copies, window)
    full, path = stored(full_windows(docs, candidates, window))
    least = full.groupBy("w0", "w1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w0", "w1", "lo")
    least = cut(least)  # as above, for a hot window
    starts = cut(full.join(least, ["w0", "w1"]).where("lo < doc_id").groupBy("doc_id", "tkey").agg(F.collect_set("start").alias("starts")))
    discard(docs.sparkSession, path)
    whole = copies.select("doc_id", "tkey", F.lit(True).alias("whole"), F.lit(None).cast("array<bigint>").alias("starts"))
    return starts.select("doc_id", "tkey", F.lit(False).alias("whole"), "starts").unionAll(whole)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), for each row."""
    rows = docs.withColumn("text", F.col(f"`{text}`")) if text != "text" else docs
    rows = rows.select(long_id(docs, doc_id), F.xxhash64("text").alias("tkey"), "text")
    # The same filtered rows are dealt out by (doc_id, tkey) for both joins, so their texts are shuffled once.
    valid = rows.where("doc_id is not null and text is not null")
    rest = rows.where("doc_id is null or text is null")
    found = repeats(valid, window)

    def work(texts, ids):
        out = {"n_words": [], "n_removed": [], "kept": []}
        for t, whole, starts in zip(texts, ids[1].to_pylist(), ids[2].to_pylist(), strict=True):
            words = (t or b"").split()
            n = len(words)
            if whole and n >= window:
                words = []
            elif starts:
                gone = rolling.covered(np.array(starts, np.int64), window, n)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept"].append(b" ".join(words))
        return {"doc_id": ids[0], **out}

    joined = valid.join(found, ["doc_id", "tkey"], "left").select("doc_id", "whole", "starts", "text")
    joined = joined.unionByName(rest.select("doc_id", "text"), allowMissingColumns=True)
    got = explode_texts(joined, work, "doc_id bigint, n_words bigint, n_removed bigint, kept binary", ["doc_id", "whole", "starts"])
    return got.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
