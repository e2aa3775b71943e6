"""Adaptive pacing of hosts: a fold over ordered signals, in batch and as a stream.

A signal has a status (null: the transport failed), latency_ms and
retry_after_ms.  It makes a host back off if the transport failed, if the
status is one of REFUSED, if an error names a time to wait, or if a good
response took far longer than the host's average.  Other errors of the server
change nothing.  CLEAN other signals in a row take one step off the interval
and give one request back; a host that is at its fastest counts none.
A null latency leaves the average as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartulary.operators import ordered

# Statuses that ask for less, signals to a recovery, the least
# growth of an interval, and what makes a response slow (both must hold).
REFUSED = (429, 502, 503, 504)
CLEAN = 20
LEAST_GROWTH_MS = 250
SLOW_FACTOR = 4
SLOW_MARGIN_MS = 1000


class Policy(NamedTuple):
    """Bounds of a host."""

    floor_ms: int = 500
    ceiling_ms: int = 60_000
    concurrency: int = 8

    @property
    def step_ms(self) -> int:
        return max(50, (self.ceiling_ms - self.floor_ms + 4) // 8)


SIGNAL = ("status", "latency_ms", "retry_after_ms")
_STATE = "n_signals bigint, interval_ms bigint, concurrency bigint, clean bigint, average_ms bigint, backoffs bigint, recoveries bigint"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def policies(declared: DataFrame) -> DataFrame:
    """The politest bounds of each host that is declared (host, kind, floor_ms, ceiling_ms, concurrency) more than once; one page makes it a page host."""
    page = F.max(F.col("kind") == "page")
    return declared.groupBy("host").agg(
        F.when(page, "page").otherwise("asset").alias("kind"), F.max("floor_ms").alias("floor_ms"), F.max("ceiling_ms").alias("ceiling_ms"),
        F.when(page, 1).otherwise(F.min("concurrency")).alias("concurrency"),
    )


def fold(signals: DataFrame, key: str, order: Sequence[str], policy: Policy = Policy()) -> DataFrame:
    """The state of each key after all its signals: counts, interval_ms, concurrency, clean, average_ms.

    Each state depends on the one before it, so a host's signals pass through
    one task, in order; only the state is held.
    """
    plain = signals.select(key, *order, *[F.col(c).cast("bigint").alias(c) for c in SIGNAL])
    begin = (0, policy.floor_ms, policy.concurrency, 0, None, 0, 0)
    return ordered.fold(plain, [key], order, SIGNAL, lambda: begin, lambda s, *x: _next(s, x, policy), lambda s: s, _STATE)


def _next(state: tuple, signal: tuple, policy: Policy) -> tuple:
    """The state after one signal; None for nulls."""
    n, interval, conc, clean, average, backoffs, recoveries = state
    status, latency, wait = signal
    timed = average is not None and latency is not None
    slow = timed and status is not None and status < 400 and latency > max(average * SLOW_FACTOR, average + SLOW_MARGIN_MS)
    bad = slow or status is None or status in REFUSED or (wait is not None and status >= 400)
    if not bad and status >= 500:
        return n + 1, *state[1:]
    if slow or not bad:
        average = (average * 8 + latency * 2 + 5) // 10 if timed else latency if average is None else average
    if bad:
        return n + 1, min(policy.ceiling_ms, max(interval * 2, interval + LEAST_GROWTH_MS)), max(1, conc // 2), 0, average, backoffs + 1, recoveries
    if interval <= policy.floor_ms and conc >= policy.concurrency:
        return n + 1, interval, conc, 0, average, backoffs, recoveries
    if clean + 1 < CLEAN:
        return n + 1, interval, conc, clean + 1, average, backoffs, recoveries
    return n + 1, max(policy.floor_ms, interval - policy.step_ms), min(policy.concurrency, conc + 1), 0, average, backoffs, recoveries + 1


def follow(signals: DataFrame, key: str, order: Sequence[str], policy: Policy = Policy()) -> DataFrame:
    """The same fold over a stream of signals: the state of each key after each micro-batch that has signals of it."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, policy.floor_ms, policy.concurrency, 0, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values([*order, *SIGNAL], na_position="first")
        for signal in rows[list(SIGNAL)].itertuples(index=False, name=None):
            now = _next(now, tuple(None if pd.isna(v) else int(v) for v in signal), policy)
        state.update(now)
        yield pd.DataFrame([(*k, *now)], columns=[key, *_NAMES]).astype({"average_ms": "Int64"})

    kind = signals.schema[key].dataType.simpleString()
    return signals.select(key, *order, *SIGNAL).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)
