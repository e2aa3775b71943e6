import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, start string, anchor int, kept string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, and awkward texts; extra columns clash with results."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    block = [" ".join(words(rng, 9)) for _ in range(5)]
    out = []

    def add(doc_id, text, lang="en", source="s0"):
        out.append((doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", 7, "k"))

    base = [words(rng, rng.randrange(60, 260)) for _ in range(24)]
    for i, w in enumerate(base):
        add(100 + i, " ".join(w), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", None]))
    for i in range(8):  # exact copies, in either direction of the ids
        add(200 - 150 * (i % 2) + i, " ".join(base[i]))
    for i in range(8):  # near copies
        w = list(base[8 + i])
        w[3] = "changed"
        add(300 + i, " ".join(w))
    for i in range(6):  # a shared passage
        add(400 + i, " ".join(words(rng, 30 + i) + passage + words(rng, 20)))
    for i in range(6):  # shared lines
        add(500 + i, "\n".join([" ".join(words(rng, 8)) for _ in range(i)] + block[: 2 + i % 4] + ["", " ".join(words(rng, 4))]))
    add(600, "\n".join(["again and again"] * 12))
    add(601, " ".join(["round"] * 120))
    for i, t in enumerate([None, "", "   ", "\n\n", "one", "one two", "Ünï cödé   ẞ x y", "!!! ??? ...", "a\tb\x0bc\x0cd\re", "12345 678"]):
        add(700 + i, t, None if i % 2 else "en")
    add(800, " ".join(words(rng, 30_000, 5000)))
    add(900, " ".join(base[0]))
    out.append(out[-1])  # a repeated row
    add(901, " ".join(base[1]))
    add(901, " ".join(base[2]))  # one id, two texts
    add(None, " ".join(base[3]))
    add(None, None)
    return out


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
