"""Quotation linking: nested quotes to the messages they quote, and conversations in reply order.

A line's quote level is the number of `>` it starts with (blanks may stand
between).  Consecutive lines of one level are a passage; its words, in lower
case and joined by one blank, are hashed.  A message's own text, its paragraphs
and its lines are hashed alike, and passages are joined to them: first the
whole passage, then its paragraphs, then its lines.  In the same conversation
the latest earlier message wins; failing that, the first message of all with
that text, if its conversation has a smaller conv_id.  The direct parent is
what the first passage of the lowest level that is linked quotes.  A message
without a parent belongs with the first message of its conv_id.  Following
both to their start gives each message its root; the messages of a root are a
conversation, and `position` is a message's place in it, by (conv_id, turn): a
reply comes after what it quotes, and the quotes are cut from the texts.

What a message belongs to is always earlier, so there are no cycles.  Only
hashes that some passage has are joined, no conversation is gathered in a task,
and positions are counted over ranges, so a hot conversation is parted.  Cases:
a null text is a message with no lines and a null body; rows that share conv_id
and turn are one message with one position, and each comes back; a row with a
null conv_id or turn is neither linked nor quoted, its own root, and has no
position.  A passage that quotes nothing known is cut from the text and leaves
no link.  Other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartulary.llm.common import cut, explode_texts

#: Turns of a conversation in which the latest message with a text is sought at once.
TURNS = 4096
_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
#: A line before a quote that names its author goes with the quote.  Fixed values: the verbs of common mail programs.
_AUTHOR = re.compile(r"\b(?:wrote|schrieb|a écrit|escribió):\s*$", re.I)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str | None:
    """The hash of a normalised text; None if it has no word."""
    return xxhash.xxh3_128_hexdigest(n.encode()) if (n := normalised(text)) else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages with their level."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        if m := _QUOTE.match(line):
            level = m[1].count(">")
            if not inside:
                while own and not own[-1].strip():
                    own.pop()
                if own and _AUTHOR.search(own[-1]):
                    own.pop()
            if not (inside and passages[-1][0] == level):
                passages.append((level, []))
            passages[-1][1].append(m[2])
            inside = True
        else:
            inside = False
            own.append(line)
    if not passages:
        return text, []
    return "\n".join(own).strip("\n"), [(n, "\n".join(x)) for n, x in passages]


def units(text: str) -> list[tuple[int, str]]:
    """Hashes of the whole text (0), its paragraphs (1) and its lines (2); each hash once, at its first rank."""
    found: dict[str, int] = {}
    for rank, parts in enumerate(([text], re.split(r"\n[ \t\r]*\n", text), text.split("\n"))):
        for p in parts:
            if h := digest(p):
                found.setdefault(h, rank)
    return [(rank, h) for h, rank in found.items()]


def _string(text: bytes | None) -> str | None:
    return None if text is None else text.decode("utf-8", "replace")


def quoted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, rank, hash: what the passages may be found by."""

    def work(texts, ids):
        rows = []
        for i, t in enumerate(texts):
            if t and b">" in t:
                rows += [(i, k, level, rank, h) for k, (level, body) in enumerate(parse(_string(t))[1]) for rank, h in units(body)]
        if not rows:
            return None
        at, passage, level, rank, h = (list(x) for x in zip(*rows, strict=True))
        conv, turn = (x.to_numpy(zero_copy_only=False)[np.array(at)] for x in ids)
        return {"conv_id": conv, "turn": turn, "passage": passage, "level": level, "rank": rank, "hash": h}

    return explode_texts(messages, work, "conv_id bigint, turn bigint, passage int, level int, rank int, hash string", ["conv_id", "turn"])


def originals(messages: DataFrame) -> DataFrame:
    """conv_id, turn, hash: the units of the messages' own texts."""

    def work(texts, ids):
        rows = [(i, h) for i, t in enumerate(texts) if t for _, h in units(parse(_string(t))[0])]
        if not rows:
            return None
        at = np.array([i for i, _ in rows])
        conv, turn = (x.to_numpy(zero_copy_only=False)[at] for x in ids)
        return {"conv_id": conv, "turn": turn, "hash": [h for _, h in rows]}

    return explode_texts(messages, work, "conv_id bigint, turn bigint, hash string", ["conv_id", "turn"])


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, to_conv, to_turn of each linked passage; messages: conv_id, turn, text, none null."""
    quotes = cut(quoted(messages))
    if quotes.isEmpty():
        return quotes.select("conv_id", "turn", "passage", "level", F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
    # Aggregates are written apart: the joins' sides are plain shuffles then, of which Spark can split a hot text's.
    asked = cut(quotes.select("hash").distinct())
    known = cut(originals(messages).join(asked, "hash", "left_semi"))
    first = cut(known.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first")))
    found = quotes.join(_latest_before(quotes, known), ["conv_id", "turn", "hash"], "left").join(first, "hash", "left")
    to = F.when(F.col("to_turn").isNotNull(), F.struct(F.lit(0).alias("far"), F.col("conv_id").alias("to_conv"), F.col("to_turn").alias("to_turn"))).when(
        F.col("first.conv_id") < F.col("conv_id"), F.struct(F.lit(1).alias("far"), F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"))
    )
    best = found.withColumn("to", to).where("to is not null").groupBy("conv_id", "turn", "passage").agg(F.min(F.struct("rank", "to.far", "to.to_conv", "to.to_turn")).alias("b"), F.min("level").alias("level"))
    return best.select("conv_id", "turn", "passage", "level", F.col("b.to_conv").alias("to_conv"), F.col("b.to_turn").alias("to_turn"))


def _latest_before(quotes: DataFrame, known: DataFrame) -> DataFrame:
    """conv_id, turn, hash, to_turn: the latest earlier message of the same conversation that has the hash.

    Sought within blocks of TURNS turns; what goes over from one block to the
    next is one row a block, so a hot text of a long conversation is parted.
    """
    here = cut(known.select("conv_id", "hash").distinct())
    keys = quotes.join(here, ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn").distinct()
    both = keys.withColumn("own", F.lit(0)).unionAll(known.select("conv_id", "hash", "turn").distinct().withColumn("own", F.lit(1)))
    both = both.withColumn("block", F.floor(F.col("turn") / TURNS))
    own = F.when(F.col("own") == 1, F.col("turn"))
    ends = both.groupBy("conv_id", "hash", "block").agg(F.max(own).alias("end"))
    over = W.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = cut(ends.select("conv_id", "hash", "block", F.max("end").over(over).alias("carried")))
    before = W.partitionBy("conv_id", "hash", "block").orderBy("turn", "own").rowsBetween(W.unboundedPreceding, -1)
    within = both.withColumn("inside", F.max(own).over(before)).where("own = 0")
    return within.join(ends, ["conv_id", "hash", "block"]).select("conv_id", "turn", "hash", F.coalesce("inside", "carried").alias("to_turn")).where("to_turn is not null")


def roots(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """conv_id, turn, to_conv, to_turn (its parent), root_conv_id, root_turn of each distinct message, by pointer jumping."""
    heads = cut(messages.groupBy("conv_id").agg(F.min("turn").alias("head")))
    up = messages.join(heads, "conv_id").join(parents, ["conv_id", "turn"], "left")
    now = cut(up.select("conv_id", "turn", "to_conv", "to_turn", F.coalesce("to_conv", "conv_id").alias("root_conv_id"), F.coalesce("to_turn", "head").alias("root_turn")))
    moved = not parents.isEmpty()
    while moved:
        further = now.select(F.col("conv_id").alias("root_conv_id"), F.col("turn").alias("root_turn"), F.col("root_conv_id").alias("c"), F.col("root_turn").alias("t"))
        nxt = now.join(further, ["root_conv_id", "root_turn"]).withColumn("moved", ~((F.col("c") == F.col("root_conv_id")) & (F.col("t") == F.col("root_turn"))))
        nxt = cut(nxt.select("conv_id", "turn", "to_conv", "to_turn", F.col("c").alias("root_conv_id"), F.col("t").alias("root_turn"), "moved"))
        moved = not nxt.where("moved").isEmpty()
        now = nxt.drop("moved")
    return now


def with_positions(placed: DataFrame) -> DataFrame:
    """placed with position, the number of a root's messages before it by (conv_id, turn); rows: distinct messages.

    Ranges of the whole order number their own rows, and each range's rows of
    a root are counted for the ranges after it.
    """
    root = ["root_conv_id", "root_turn"]
    ranged = cut(placed.repartitionByRange(*root, "conv_id", "turn").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(*root, "range").agg(F.count("*").alias("n"))
    before = W.partitionBy(*root).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(counts.select(*root, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = F.row_number().over(W.partitionBy(*root, "range").orderBy("conv_id", "turn")) - 1
    return ranged.withColumn("inside", inside).join(starts, [*root, "range"]).withColumn("position", F.col("start") + F.col("inside")).drop("range", "start", "inside")


def reply_order(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, n_quotes, max_level, parent_conv_id, parent_turn, root_conv_id, root_turn, position, for each row."""
    rows = messages.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").alias("text"))
    valid = rows.where("conv_id is not null and turn is not null")
    links = cut(link(valid.where("text is not null").select("conv_id", "turn", "text")))
    parents = cut(links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "passage", "to_conv", "to_turn")).alias("p")).select("conv_id", "turn", "p.to_conv", "p.to_turn"))
    placed = with_positions(roots(valid.select("conv_id", "turn").distinct(), parents))

    def work(texts, ids):
        parsed = [(None, []) if t is None else parse(_string(t)) if b">" in t else (_string(t), []) for t in texts]
        return dict(zip(("conv_id", "turn", "role"), ids, strict=True)) | {"body": pa.array([p[0] for p in parsed], pa.string()), "n_quotes": [len(p[1]) for p in parsed], "max_level": [max((n for n, _ in p[1]), default=0) for p in parsed]}

    clean = explode_texts(rows, work, "conv_id bigint, turn bigint, role string, body string, n_quotes int, max_level int", ["conv_id", "turn", "role"])
    joined = clean.join(placed, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "body", "n_quotes", "max_level", F.col("to_conv").alias("parent_conv_id"), F.col("to_turn").alias("parent_turn"),
        F.coalesce("root_conv_id", "conv_id").alias("root_conv_id"), F.coalesce("root_turn", "turn").alias("root_turn"), "position",
    )
