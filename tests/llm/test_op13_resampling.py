import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cartulary.llm import resampling
from cartulary.llm.merging import LoserTree, Merge

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def grams(text, longest):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(UPPER, LOWER)))
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, percent=10, least=20):
    parts = [(d, *grams(t, longest)) for d, t in docs]
    bucket = lambda g: zlib.crc32(g) % 10_000
    s, t = Counter(bucket(g) for _, _, gs in parts for g in gs), Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for d, words, gs in parts:
        weight = sum(gain(bucket(g)) for g in gs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn(found):
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(4)
    rows = [(str(i), " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(20)] + [("x", None), ("y", ""), ("z", "Ünï W1 W2")]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_equals_brute_force(messy, target, longest, percent):
    want = brute([(r.doc_id, r.text) for r in messy.collect()], [r.text for r in target.collect()], longest, percent)
    assert drawn(resampling.resample(messy, target, longest=longest, percent=percent)) == want


def test_many_runs_blocks_and_ranges(messy, target, monkeypatch):
    want = brute([(r.doc_id, r.text) for r in messy.collect()], [r.text for r in target.collect()], percent=40)
    for name, value in (("RUN_ROWS", 7), ("BLOCK_ROWS", 2), ("RANGE_ROWS", 12)):
        monkeypatch.setattr(resampling, name, value)
    assert drawn(resampling.resample(messy, target, percent=40)) == want


def test_ties_by_id(spark):
    rows = [(i, "one " * 25 if i % 3 else "two " * 30) for i in range(90, 0, -1)] + [(5, "one " * 25)] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    goal = spark.createDataFrame([("two two",)], "text string")
    assert drawn(resampling.resample(df, goal, percent=50)) == brute(rows, ["two two"], percent=50)


def test_empty_tables(spark, empty, messy, target):
    assert drawn(resampling.resample(empty, target)) == []
    none = target.where("false")
    assert drawn(resampling.resample(messy, none)) == brute([(r.doc_id, r.text) for r in messy.collect()], [])
    short = messy.where("doc_id between 700 and 705")
    assert {r[4] for r in drawn(resampling.resample(short, target))} == {None}


def test_tree_opens_blocks_late_and_keeps_what_is_left():
    rng = random.Random(2)
    numbers = [rng.randrange(10_000) for _ in range(2_000)]
    blocks = sorted((sorted(numbers[i : i + 50]) for i in range(0, 2_000, 50)), key=lambda b: b[0])
    opened = []

    def coming():
        for b in blocks:
            opened.append(b[0])
            yield b[0], iter(b)

    merge = Merge(LoserTree(lambda x: x), coming())
    got = [x for _, x in zip(range(700), merge, strict=False)]
    assert got == sorted(numbers)[:700]
    assert all(x <= got[-1] for x in opened[:-1])  # one ahead
    assert sorted(got + list(merge.left())) == sorted(numbers)
