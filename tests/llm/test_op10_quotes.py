import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there, friend.\n\nSecond paragraph here"),
    (1, 1, "assistant", "On Monday Ann wrote:\n> Hello  there, FRIEND.\n\nreply one"),
    (1, 2, "user", "> reply one\n>> Hello there, friend.\nthird"),
    (1, 3, "user", "reply one"),
    (1, 4, "user", "> > reply one\n> third\nfifth"),
    (2, 0, "user", "fresh start"), (2, 1, "user", "> reply one\nfrom another"), (2, 2, "user", "> nothing known\nbody"), (2, 2, "user", "> fresh start\nagain"),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 2, None, ">\n> \n"), (3, 3, "user", "a > b\n5 >= 3"),
    (None, 1, "user", "> fresh start\nx"), (4, None, "user", "> fresh start"), (0, 0, "user", "> fresh start\nearlier conversation"),
]


def brute(rows):
    """The same by loops: parents, then roots by following them."""
    known = []
    asks: dict[tuple, list] = {}
    for c, t, _, text in rows:
        if None in (c, t, text):
            continue
        body, passages = quotes.parse(text)
        known += [(h, c, t) for _, h in quotes.units(body)]
        asks.setdefault((c, t), []).extend((level, k, quotes.units(p)) for k, (level, p) in enumerate(passages))
    parent = {}
    for (c, t), passages in asks.items():
        best = {}
        for level, k, tried in passages:
            for rank, h in tried:
                same = [b for g, a, b in known if g == h and a == c and b < t]
                first = min(((a, b) for g, a, b in known if g == h), default=None)
                to = (0, c, max(same)) if same else (1, *first) if first and first[0] < c else None
                if to:
                    x = (rank, to)
                    if k not in best or x < best[k][1]:
                        best[k] = (min(level, best[k][0]) if k in best else level, x)
                    else:
                        best[k] = (min(level, best[k][0]), best[k][1])
        if best:
            parent[c, t] = min((level, k, x[1][1:]) for k, (level, x) in best.items())[2]
    messages = sorted({(c, t) for c, t, _, _ in rows if c is not None and t is not None})
    head, root, members = {}, {}, {}
    for m in messages:  # what a message belongs to comes before it
        first = head.setdefault(m[0], m)
        to = parent.get(m, first)
        root[m] = m if to == m else root[to]
        members.setdefault(root[m], []).append(m)
    place = {m: i for own in members.values() for i, m in enumerate(own)}
    out = []
    for c, t, role, text in rows:
        body, passages = quotes.parse(text) if text is not None else (None, [])
        out.append((c, t, role, body, len(passages), max((n for n, _ in passages), default=0), *parent.get((c, t), (None, None)), *root.get((c, t), (c, t)), place.get((c, t))))
    return sorted(out, key=repr)


def corpus(seed: int, conversations: int, hot: int) -> list[tuple]:
    """Threads with nested quotes of earlier messages, here and elsewhere, a long text, and one long conversation in which most say and quote the same."""
    rng = random.Random(seed)
    said: list[str] = []
    out = []
    for c in range(conversations):
        mine: list[str] = []
        for t in range(rng.randrange(1, 12)):
            lines = []
            if mine and rng.random() < 0.6:
                lines += ["> " + x for x in rng.choice(mine).split("\n")]
                if rng.random() < 0.3:
                    lines += [">> " + x for x in rng.choice(mine).split("\n")]
            if said and rng.random() < 0.2:
                lines += ["", "> " + rng.choice(said).split("\n")[0]]
            own = rng.choice(["thanks", f"point {c} {t}\n\nmore of {t}", " ".join(f"w{rng.randrange(50)}" for _ in range(20))])
            out.append((c, t, "u", "\n".join([*lines, own])))
            mine.append(own)
            said.append(own)
    out += [(900, t, "u", "thanks" if t % 3 else "> thanks\nthanks") for t in range(hot)]
    long = " ".join(f"long{i}" for i in range(60_000))
    return [*out, (901, 0, "u", long), (901, 1, "a", "> " + long + "\n>> thanks\nanswer"), (901, 1, "a", "> thanks\nsaid twice")]


@pytest.mark.parametrize("turns", [4096, 16])
def test_a_corpus_against_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(quotes, "TURNS", turns)
    rows = corpus(5, 60, 240)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = sorted([tuple(r) for r in quotes.reply_order(df).collect()], key=repr)
    want = brute(rows)
    assert got == want and sum(r[6] is not None for r in got) > 150 and len({r[8:10] for r in got}) < 60


@pytest.mark.parametrize("rows", [ROWS, [(7, i, "u", f"{'> message %d' % (i - 1) if i else 'start'}\nmessage {i}") for i in range(40)]])
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, hash int").repartition(3)
    got = sorted([tuple(r) for r in quotes.reply_order(df).collect()], key=repr)
    assert got == brute(rows)


def test_parse_levels():
    body, passages = quotes.parse("a\nBob wrote:\n> x\n> y\n>> z\n > w\nb\n>c")
    assert body == "a\nb" and passages == [(1, "x\ny"), (2, "z"), (1, "w"), (1, "c")]
    assert quotes.parse("no quote\n") == ("no quote\n", [])


def test_reply_follows_what_it_quotes(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    order = {}
    for i, r in enumerate(quotes.reply_order(df).where("conv_id is not null and turn is not null").orderBy("root_conv_id", "root_turn", "position").collect()):
        order[r.conv_id, r.turn] = i
        assert r.body is None or not re.search(r"^\s*>", r.body, re.M)
        if r.parent_conv_id is not None:
            assert order[r.parent_conv_id, r.parent_turn] < i


def test_tables_without_quotes_and_empty(spark):
    d = "/root/testdata/sf0.001"
    messages = spark.read.parquet(f"{d}/conversations.parquet")
    got = quotes.reply_order(messages)
    assert got.count() == messages.count() and got.where("parent_conv_id is not null or body is null").count() == 0
    assert quotes.reply_order(messages.limit(0)).count() == 0
    turns = W.partitionBy("conv_id").orderBy("turn")
    assert got.withColumn("n", F.dense_rank().over(turns) - 1).where("position <> n or root_conv_id <> conv_id").count() == 0
