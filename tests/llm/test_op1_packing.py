import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartulary.llm import packing
from cartulary.llm.queries import vocabulary

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\nb", "a\n\n b", "x \n y", "tab\there", "it's we'll don't", "12 345 x", " wide", "é è ê", "日本語 テキスト", "<|endoftext|>", "a <|endoftext|> b", "1.5 %$ #", "end\n"]


def test_ids_equal_the_tokenizer():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Tokens(*vocabulary())
    for t in [*ODD, *(a + b for a in ODD for b in ODD[:8])]:
        assert np.frombuffer(own.ids(t), "<u2").tolist() == coder.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_equal_the_tokenizer_on_random_texts():
    """Runs of blanks, line ends, digits, marks, joiners and letters of several scripts, in any order."""
    rng = random.Random(8)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Tokens(*vocabulary())
    pieces = [" ", " ", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u200d", "\u0301", "a", "the", "Wörter", "ñandú", "'s", "'", "12", "3", "٣", ".", ",,", "#$", "日本", "ß", "🙂", "x1", "<|", "|>", "endoftext", "\x00", "\x85", "\u2028"]
    for _ in range(20_000):
        t = "".join(rng.choices(pieces, k=rng.randrange(1, 12)))
        assert np.frombuffer(own.ids(t), "<u2").tolist() == coder.encode(t, add_special_tokens=False).ids, repr(t)


def naive(rows, length):
    """(doc_id, start, length, number of the sequence, offset): ids in the given order, cut at length and the rest at powers of two."""
    flat = [(doc, i) for doc, ids in rows for i in range(len(ids))]
    cuts, at = [], 0
    while at < len(flat):
        left = len(flat) - at
        size = length if left >= length else 1 << (left.bit_length() - 1)
        cuts.append((at, at + size))
        at += size
    out = []
    for number, (a, b) in enumerate(cuts):
        start = a
        for i in range(a + 1, b + 1):
            if i == b or flat[i][1] == 0:  # a piece ends with its sequence or its document
                out.append((flat[start][0], flat[start][1], i - start, number, start - a))
                start = i
    return out


def test_pieces_against_a_naive_packer(messy, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 20_000)  # several partitions of the curve
    rows = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    coder = packing.Tokens(*vocabulary())
    texts = {r.doc_id: np.append(np.frombuffer(coder.ids(r.text or ""), "<u2"), packing.END) for r in rows.select("doc_id", "text").collect()}
    got = packing.pack(rows, *vocabulary(), length=128).toPandas()
    got["part"] = got.sequence_id // (1 << 40)
    assert got.part.nunique() > 2
    last = None
    for part, own in sorted(got.groupby("part"), key=lambda x: x[0]):
        order = own[["key", "doc_id"]].drop_duplicates().sort_values(["key", "doc_id"])
        assert last is None or last < tuple(order.iloc[0])  # partitions follow each other along the curve
        last = tuple(order.iloc[-1])
        want = naive([(d, texts[d]) for d in order.doc_id], 128)
        have = own.assign(number=own.sequence_id - (int(part) << 40)).sort_values(["number", "offset"])
        assert [tuple(r) for r in have[["doc_id", "start", "length", "number", "offset"]].itertuples(index=False)] == want


def test_hilbert_is_a_path_through_every_cell():
    for bits, n in ((2, 3), (3, 2)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * n), -1).reshape(-1, n)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_every_id_lies_in_one_piece(messy):
    rows = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(rows, *vocabulary(), length=128).withColumn("crc", F.crc32("ids")).toPandas()
    coder = packing.Tokens(*vocabulary())
    texts = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
    assert set(got.doc_id) == set(texts)
    for doc_id, own in got.groupby("doc_id"):
        ids = np.append(np.frombuffer(coder.ids(texts[doc_id] or ""), "<u2"), packing.END).astype("<u4")
        own, at = own.sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids == ids[at : at + p.length].tobytes() and p.crc == zlib.crc32(p.ids)
            at += p.length
        assert at == len(ids)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        assert (n := int(seq.length.sum())) <= 128 and n & (n - 1) == 0


def test_repeated_rows_null_ids_and_empty_tables(messy, empty):
    got = packing.pack(messy, *vocabulary(), length=128)
    n = messy.count()
    assert got.where("start = 0").count() == n
    assert got.where("doc_id is null and start = 0").count() == 2
    assert packing.pack(empty, *vocabulary()).count() == 0


def test_neighbours_are_alike(spark):
    rows = [(i, ("alpha beta gamma " if i % 2 else "delta epsilon zeta ") * 30) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), *vocabulary()).orderBy("sequence_id", "offset").toPandas().drop_duplicates("doc_id")
    kinds = (got.doc_id % 2).tolist()
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 4
