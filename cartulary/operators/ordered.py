"""Folds over the ordered records of each key, with one running state held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], begin: Callable[[], Any], step: Callable[..., tuple[Any, list[tuple]]], end: Callable[[Any], list[tuple]], made: str) -> DataFrame:
    """The columns keys and made: whatever rows step(state, *values) gives beside the next state, for a key's records by order, and at last end of its state.

    Spark's sort, which spills, brings a key's records one after the other; of
    them only a batch and the state are held, however many a key has.  Nulls are
    a key of their own and come first in the order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(made)
    arrow = [to_arrow_type(f.dataType) for f in fields]
    names, n = [*keys, *fields.names], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, now, state = [], None, None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, [*types, *arrow], strict=True)], names=names)

        for batch in batches:
            types, done = [batch.schema.field(i).type for i in range(n)], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != now:
                    if now is not None:
                        done += [(*now, *x) for x in end(state)]
                    now, state = row[:n], begin()
                state, out = step(state, *row[n:])
                done += [(*now, *x) for x in out]
            if done:
                yield rows(done)
        if now is not None and (last := [(*now, *x) for x in end(state)]):
            yield rows(last)

    # Named apart, as keys, order and values may share columns.
    cols = [*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]]
    ks, vs, os = ([f"{p}{i}" for i in range(len(x))] for p, x in (("k", keys), ("v", values), ("o", order)))
    dealt = df.select(*cols).repartition(*ks).sortWithinPartitions(*ks, *os, *vs).select(*ks, *vs)
    return dealt.mapInArrow(run, T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keys], *fields]))


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], begin: Callable[[], Any], step: Callable[..., Any], end: Callable[[Any], tuple], made: str) -> DataFrame:
    """The columns keys and made of each key: end of the state after step(state, *values) for its records by order; see scan."""
    return scan(df, keys, order, values, begin, lambda state, *x: (step(state, *x), []), lambda state: [end(state)], made)
