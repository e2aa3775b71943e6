import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import rules


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    again = [False] * len(words)
    for i, g in enumerate(grams):
        if often[g] > 1:
            again[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(again)


def test_counts_against_brute_force(messy):
    rows = messy
    got = sorted([tuple(r) for r in rules.judge(rows).select("doc_id", *rules.NAMES, "base_failed").collect()], key=repr)
    want = []
    for r in rows.select("doc_id", "text").collect():
        b = base(r.text)
        want.append((r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want, key=repr)


def brute_verdicts(rows, prior):
    """kept of each row by loops: exact quartiles of each group, its language and all, averaged by weight."""
    seen = []
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, again = base(text)
        bad = n < 50 or 100 * again > 50 * n
        ratios = {"word_length": chars / n, "symbol_share": symbols / n, "dup_line_share": dup / n, "repeat_share": again / n} if n else dict.fromkeys(rules.RATIOS, 0.0)
        seen.append((doc_id, lang, source, bad, ratios))
    good = [x for x in seen if not x[3]]

    def quartile(own, name, part):
        values = sorted(x[4][name] for x in own)
        return values[math.ceil(part * len(values)) - 1] if values else 0.0

    out = []
    for doc_id, lang, source, bad, ratios in seen:
        fine = not bad
        for name, (_, least, both) in rules.RATIOS.items():
            ends = []
            for part in (0.25, 0.75):
                q = quartile(good, name, part)
                for own in ([x for x in good if x[1] == lang], [x for x in good if x[1:3] == (lang, source)]):
                    q = (len(own) * quartile(own, name, part) + prior * q) / (len(own) + prior)
                ends.append(q)
            reach = 3 * max(ends[1] - ends[0], least)
            fine &= ratios[name] <= ends[1] + reach and not (both and ratios[name] < ends[0] - reach)
        out.append((doc_id, fine))
    return sorted(out, key=repr)


@pytest.mark.parametrize("prior", [200, 5])
def test_verdicts_against_exact_quartiles(spark, messy, prior):
    rows = [tuple(r) for r in messy.select("doc_id", "text", "lang", "source").collect()]
    rng = np.random.default_rng(3)
    for i in range(150):  # groups of many sizes, some of which have texts out of the ordinary
        words = [f"{'#' * int(rng.integers(0, 1 + i % 4))}{'x' * int(rng.integers(1, 4 + 20 * (i % 17 == 0)))}{rng.integers(900)}" for _ in range(60)]
        rows.append((5000 + i, " ".join(words) + ("\nsame" * (i % 5 * 3)), "en" if i % 3 else "pt", f"s{i % 7}" if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = sorted([(r.doc_id, r.kept) for r in rules.judge(df, prior=prior).collect()], key=repr)
    assert got == brute_verdicts(rows, prior) and 10 < sum(not k for _, k in got) < len(got) - 100


def test_repeated_words_with_a_large_vocabulary():
    rng = np.random.default_rng(1)
    words = [str(x).encode() for x in rng.permutation(1 << 20)[: (1 << 20)]]
    words += words[10:13]
    assert rules.repeated_words(words + [b"end"]) == 6


def test_fences_of_groups(spark):
    clean = [(i, " ".join(f"w{i:03d}x{k:02d}" for k in range(80)), "en", "good" if i % 2 else "other", "clash") for i in range(600)]
    odd = [(9000, " ".join(f"$w{k}$$$" for k in range(80)), "en", "good", ""), (9001, " ".join(f"v{k:03d}x00" for k in range(80)), "fr", None, ""), (9002, " ".join("abcdefghijklmnopqrstuvwxyz" + str(k) for k in range(80)), None, "rare", "")]
    symbols = [(2000 + i, " ".join(f"#w{i:03d}x{k:02d}" for k in range(80)), "en", "tags", "") for i in range(300)]
    df = spark.createDataFrame(clean + odd + symbols, "doc_id bigint, text string, lang string, source string, q string").repartition(4)
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert all(got[i].kept for i in range(600)) and got[9001].kept
    assert all(got[2000 + i].kept for i in range(300))  # symbols are usual in that source
    assert not got[9000].kept and got[9000].failed == ["symbol_share"]
    assert not got[9002].kept and got[9002].failed == ["word_length"]


def test_empty_and_short(messy, empty):
    assert rules.judge(empty).count() == 0
    short = rules.judge(messy.where(F.coalesce(F.length("text"), F.lit(0)) < 50))
    assert short.where("kept").count() == 0 and short.where("kept is null or base_failed is null").count() == 0
