"""Text search: substrings that never span fields, overlapping chunks, prefix-AND."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk's length and the stride between chunks, in code points.
CHUNK = 12 * 1024
STRIDE = 3073
#: Spark's collation without case and diacritics.
FOLDED = "UNICODE_CI_AI"


def contains_any(fields: Sequence[Column], query: str) -> Column:
    """Whether one of the fields has the (normalised) query in it; null fields have nothing."""
    if not query:
        raise ValueError("an empty query matches nothing in particular")
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(f, F.lit(query)), F.lit(False)) for f in fields])


def chunks(df: DataFrame, text: Column, length: int = CHUNK, stride: int = STRIDE) -> DataFrame:
    """A row for each chunk of text: chunk (from 0) and chunk_text; the last one reaches the end; none for a null text.

    The text is cut into pieces of a stride in one pass, and a chunk is put
    together from the pieces that it covers, so the work is linear in the text.
    """
    if not 0 < stride <= length:
        raise ValueError("chunks must overlap or touch")
    whole, rest = divmod(length, stride)
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0))
    last = F.greatest(F.ceil((F.char_length(text) - length) / stride), F.lit(0)).cast("bigint")

    def chunk(i: Column) -> Column:
        first = (i + 1).cast("int")
        parts = [F.array_join(F.slice("__pieces", first, whole), "")]
        if rest:
            parts.append(F.coalesce(F.substring(F.get("__pieces", (i + whole).cast("int")), 1, rest), F.lit("")))
        return F.concat(*parts)

    at = df.withColumns({"__pieces": pieces, "__last": last})
    made = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("__last")), chunk)
    rows = at.select(*df.columns, F.posexplode(made).alias("chunk", "chunk_text"))
    return rows.withColumn("chunk", F.col("chunk").cast("bigint"))


def prefix_and(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether each prefix starts some token of text (letters, digits and their marks); case and diacritics don't count."""
    tokens = F.split(text, r"[^\p{L}\p{N}\p{M}]+")

    def some(prefix: str) -> Column:
        return F.exists(tokens, lambda t: F.startswith(F.collate(t, FOLDED), F.collate(F.lit(prefix), FOLDED)))

    return reduce(lambda a, b: a & b, map(some, prefixes))
