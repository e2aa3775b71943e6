"""A run's acquisition budget: charged before a dispatch, settled after it, closed at its deadline.

events: run_id, seq, at (milliseconds), kind, id, bytes, and max_dispatches,
max_bytes, deadline of a policy.  Kinds:

- policy: the run's limits from now on; what has been charged stays;
- reserve: asks for a dispatch of at most `bytes`.  It is granted unless a
  dimension limits it, looked at in this order: ownership (the id has a
  reservation that is not settled), policy_missing, deadline, dispatches,
  source_bytes (what is charged and reserved leaves too little).  A grant
  charges a dispatch for good and reserves the bytes;
- settle: gives the id's reservation back and charges the bytes that came.  A
  settlement of nothing that is open is ignored, so replays do no harm.

When the deadline passes, the run is closed by a row of its own: by the first
later event, or by a timer if there is none.  Null bytes count as 0.

The same step runs over a table (a run's events in one task by their order; only
its state is held, of open reservations no more than max_dispatches) and over a
stream, with the state in Spark's store and a timer at the deadline.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cartulary.operators import ordered

VALUES = ["seq", "at", "kind", "id", "bytes", "max_dispatches", "max_bytes", "deadline"]
ROW = "seq bigint, decision string, dimension string, charged_dispatches bigint, charged_bytes bigint, reserved_bytes bigint, n_open bigint"
_ACCOUNT = "max_dispatches bigint, max_bytes bigint, deadline bigint, closed boolean, dispatches bigint, charged bigint, reserved bigint"


class Account:
    """The state of a run."""

    def __init__(self, fields: tuple = (None, None, None, False, 0, 0, 0), open_: dict[str, int] | None = None) -> None:
        self.max_dispatches, self.max_bytes, self.deadline, self.closed, self.dispatches, self.charged, self.reserved = fields
        self.open = open_ or {}

    def fields(self) -> tuple:
        return self.max_dispatches, self.max_bytes, self.deadline, self.closed, self.dispatches, self.charged, self.reserved

    def _row(self, seq: int | None, decision: str, dimension: str | None = None) -> tuple:
        return seq, decision, dimension, self.dispatches, self.charged, self.reserved, len(self.open)

    def close(self, now: int | None) -> list[tuple]:
        """The closing row, once, if the deadline has passed."""
        if self.deadline is None or self.closed or now is None or now < self.deadline:
            return []
        self.closed = True
        return [self._row(None, "closed", "deadline")]

    def _limit(self, at: int, id_: str, size: int) -> str | None:
        if id_ in self.open:
            return "ownership"
        if self.max_dispatches is None:
            return "policy_missing"
        if at >= self.deadline:
            return "deadline"
        if self.dispatches >= self.max_dispatches:
            return "dispatches"
        return "source_bytes" if size > self.max_bytes - self.charged - self.reserved else None

    def step(self, seq: int, at: int, kind: str, id_: str, size: int | None, max_dispatches: int | None, max_bytes: int | None, deadline: int | None) -> list[tuple]:
        out, size = self.close(at), size or 0
        if kind == "policy":
            self.max_dispatches, self.max_bytes, self.deadline, self.closed = max_dispatches, max_bytes, deadline, False
            return [*out, self._row(seq, "policy")]
        if kind == "settle":
            held = self.open.pop(id_, None)
            if held is None:
                return [*out, self._row(seq, "ignored")]
            self.reserved -= held
            self.charged += size
            return [*out, self._row(seq, "settled")]
        limit = self._limit(at, id_, size)
        if limit is None:
            self.dispatches += 1
            self.reserved += size
            self.open[id_] = size
        return [*out, self._row(seq, "paused" if limit else "granted", limit)]


def settle(events: DataFrame, now: int) -> DataFrame:
    """run_id and ROW for each event, in order of seq, and for each deadline that has passed by `now`."""

    def step(state: Account, *event: Any) -> tuple[Account, list[tuple]]:
        return state, state.step(*event)

    kinds = {"kind": "string", "id": "string"}
    plain = events.select("run_id", *[F.col(c).cast(kinds.get(c, "bigint")).alias(c) for c in VALUES])
    return ordered.scan(plain, ["run_id"], ["seq"], VALUES, Account, step, lambda state: state.close(now), ROW)


class Ledger(StatefulProcessor):
    """The account of each run in the state store, its open reservations in a map beside it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", _ACCOUNT)
        self.open = handle.getMapState("open", "id string", "bytes bigint")

    def _load(self) -> Account:
        fields = tuple(self.account.get()) if self.account.exists() else None
        return Account(*([fields] if fields else []), open_={k[0]: v[0] for k, v in self.open.iterator()})

    def _save(self, before: dict[str, int], now: Account) -> None:
        self.account.update(now.fields())
        for gone in before.keys() - now.open.keys():
            self.open.removeKey((gone,))
        for id_, size in now.open.items():
            if before.get(id_) != size:
                self.open.updateValue((id_,), (size,))

    def _rows(self, key: Any, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [x.split()[0] for x in ROW.split(", ")]
            kinds = dict.fromkeys([n for n in names if n not in ("decision", "dimension")], "Int64")
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["run_id", *names]).astype(kinds)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = self._load()
        before, deadline = dict(now.open), now.deadline
        events = pd.concat(list(rows)).sort_values("seq")[VALUES]
        out = []
        for event in events.itertuples(index=False, name=None):
            out += now.step(*(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in event))
        self._save(before, now)
        if now.deadline != deadline and not now.closed:
            self.handle.registerTimer(now.deadline)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self._load()
        out = now.close(expiredTimerInfo.getExpiryTimeInMs())
        self._save(dict(now.open), now)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def follow(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """settle over a stream: rows of each event as it comes, of each deadline as event time (`at`) passes it.

    A run's events come in order of seq.  Needs the RocksDB state store.
    """
    kind = events.schema["run_id"].dataType.simpleString()
    timed = events.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", lateness)
    return timed.groupBy("run_id").transformWithStateInPandas(Ledger(), f"run_id {kind}, {ROW}", "append", "eventTime")
