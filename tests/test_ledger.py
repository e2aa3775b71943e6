import random

import pytest

from cartulary.streaming import ledger

EVENT = "run_id string, seq bigint, at bigint, kind string, id string, bytes bigint, max_dispatches bigint, max_bytes bigint, deadline bigint"


def policy(run, seq, at, dispatches, size, deadline):
    return run, seq, at, "policy", None, None, dispatches, size, deadline


def ask(run, seq, at, id_, size):
    return run, seq, at, "reserve", id_, size, None, None, None


def give(run, seq, at, id_, size):
    return run, seq, at, "settle", id_, size, None, None, None


def settled(spark, events, now=10_000):
    return sorted((tuple(r) for r in ledger.settle(spark.createDataFrame(events, EVENT), now).collect()), key=repr)


def test_dimensions_in_their_order(spark):
    events = [
        ask("a", 1, 1, "x", 5), policy("a", 2, 2, 3, 100, 50), ask("a", 3, 3, "x", 60), ask("a", 4, 4, "x", 1), ask("a", 5, 5, "y", 50), give("a", 6, 6, "x", 20), give("a", 7, 6, "x", 20), ask("a", 8, 7, "y", 50),
        ask("a", 9, 8, "z", 31), ask("a", 10, 9, "z", None), ask("a", 11, 10, "w", 0), ask("a", 12, 50, "v", 0), policy("a", 13, 51, 9, 100, 90), ask("a", 14, 52, "v", 30), ask("a", 15, 53, "u", 1),
    ]
    got = {r[1]: r[2:] for r in settled(spark, events, 60) if r[1] is not None}
    assert got == {
        1: ("paused", "policy_missing", 0, 0, 0, 0), 2: ("policy", None, 0, 0, 0, 0), 3: ("granted", None, 1, 0, 60, 1), 4: ("paused", "ownership", 1, 0, 60, 1), 5: ("paused", "source_bytes", 1, 0, 60, 1),
        6: ("settled", None, 1, 20, 0, 0), 7: ("ignored", None, 1, 20, 0, 0), 8: ("granted", None, 2, 20, 50, 1), 9: ("paused", "source_bytes", 2, 20, 50, 1), 10: ("granted", None, 3, 20, 50, 2),
        11: ("paused", "dispatches", 3, 20, 50, 2), 12: ("paused", "deadline", 3, 20, 50, 2), 13: ("policy", None, 3, 20, 50, 2), 14: ("granted", None, 4, 20, 80, 3), 15: ("paused", "source_bytes", 4, 20, 80, 3),
    }
    assert [r for r in settled(spark, events, 60) if r[1] is None] == [("a", None, "closed", "deadline", 3, 20, 50, 2)]
    assert len([r for r in settled(spark, events, 90) if r[1] is None]) == 2


def test_runs_without_events_or_policies(spark):
    assert settled(spark, []) == []
    assert settled(spark, [give("a", 1, 1, "x", 3)]) == [("a", 1, "ignored", None, 0, 0, 0, 0)]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_and_table_agree_over_an_expired_deadline(spark, tmp_path, rocksdb):
    """Micro-batches of the same events; "a" is closed by its timer, "b" by a later event, "c" not yet."""
    rng = random.Random(5)
    events, at = [], 0
    for seq in range(1, 61):
        at += rng.randrange(5, 15)
        for run, stop in (("a", 25), ("b", 99), ("c", 99)):
            if seq == 1:
                events.append(policy(run, 1, at * 1000, 12, 900, {"a": 400, "b": 300, "c": 10_000}[run] * 1000))
            elif seq < stop:
                one = ask if rng.random() < 0.6 else give
                events.append(one(run, seq, at * 1000, f"x{rng.randrange(4)}", rng.randrange(120)))
    source = tmp_path / "in"
    for k in range(0, 61, 12):
        part = [e for e in events if k <= e[1] < k + 12]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = ledger.follow(stream).writeStream.format("memory").queryName("ledger_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = sorted((tuple(r) for r in spark.table("ledger_rows").collect()), key=repr)
    want = settled(spark, events, at * 1000)
    assert [r for r in want if r[2] == "closed"] != [] and {r[0] for r in want if r[2] == "closed"} == {"a", "b"}
    assert got == want
