"""Stateful processors on streams that come in batches, late, repeated and out of order."""

import datetime
import random

import pytest

pytest.importorskip("google.protobuf")  # Spark's own state protocol in Python needs it

from webstrata.streaming import state as K  # noqa: E402

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def play(spark, tmp_path, batches, schema, plan, name="s"):
    """Run a stream over batches, a start and a stop for each, so that all state goes through the checkpoint; the rows of each."""
    src, out, rows = tmp_path / f"{name}-in", tmp_path / f"{name}-out", []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = plan(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90), "the stream should end with what is available"
        every = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
        rows.append([r for r in every if r not in [x for got in rows for x in got]])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return rows


def test_time_outs(spark, tmp_path):
    batches = [
        [("a", "start", at(0)), ("a", "start", at(3)), ("b", "start", at(0)), ("b", "end", at(5)), ("late", "end", at(9))],  # a repeats; late's end comes first
        [("late", "start", at(8)), ("c", "start", at(30)), (None, "start", None)],
        [("d", "start", at(70))],  # the watermark passes 35 + 0
        [("c", "end", at(61)), ("a", "start", at(75)), ("d", "end", at(104))],  # c's end is in time by its own clock
        [("e", "start", at(200))],
        [("e", "end", at(201))],
    ]
    got = play(spark, tmp_path, batches, "url string, state string, ts timestamp", lambda s: K.timed_out(s, 35_000, "10 seconds"))
    ms = lambda s: int(at(s).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    failed = [(r[0], r[3], r[4]) for rows in got for r in rows]
    assert ("a", ms(0), ms(35)) in failed and ("a", ms(75), ms(110)) in failed and len(failed) == 2, failed
    assert all(r[1] == "Process URL timeout" for rows in got for r in rows)


def slow_cache(events, most, ttl):
    """One part without eviction, event by event."""
    known, out = {}, []
    for name, value, ts, fetched in sorted(events, key=lambda e: (e[2], not e[3], e[0], e[1] or "")):
        if fetched:
            known[name] = (value, ts)
        else:
            hit = name in known and ts - known[name][1] < ttl
            out.append((name, ts, hit, known[name][0] if hit else None))
    return sorted(out, key=str)


def test_cache(spark, tmp_path):
    rng = random.Random(4)
    events, clock = [], 0
    for _ in range(120):
        clock += rng.randint(1, 5)
        events.append((f"k{rng.randint(0, 9)}", f"v{clock}", clock, True) if rng.random() < 0.4 else (f"k{rng.randint(0, 9)}", None, clock, False))
    batches = [[(n, v, at(s), f) for n, v, s, f in events[i : i + 30]] for i in range(0, 120, 30)]
    batches[1] += batches[1][:3]  # repeated events

    def plan(s):
        return K.cached(s.where("NOT fetched").select("key", "ts"), s.where("fetched").select("key", "value", "ts"), 1000, 60_000, 4)

    got = [r for rows in play(spark, tmp_path, batches, "key string, value string, ts timestamp, fetched boolean", plan) for r in rows]
    want = slow_cache([(n, v, at(s), f) for n, v, s, f in events], 1000, datetime.timedelta(seconds=60))
    assert sorted(set(got), key=str) == sorted(set(want), key=str)
    assert {r[2] for r in got} == {True, False}


def test_cache_is_bounded(spark, tmp_path):
    """Past its limit a cache lets its oldest entries go."""
    schema = "key string, value string, ts timestamp, fetched boolean"
    batches = [[(f"k{i}", "v", at(i), True) for i in range(b, b + 25)] for b in (0, 25)] + [[(f"k{i}", None, at(60), False) for i in range(50)]]

    def plan(s):
        return K.cached(s.where("NOT fetched").select("key", "ts"), s.where("fetched").select("key", "value", "ts"), 20, 10**9, 1)

    got = play(spark, tmp_path, batches, schema, plan)[-1]
    hits = sorted(int(r[0][1:]) for r in got if r[2])
    assert len(got) == 50 and 18 <= len(hits) <= 20 and hits == list(range(50 - len(hits), 50))


def test_rates(spark, tmp_path):
    batches = [[("r", at(0), 0), ("r", at(2), 10), ("r", at(2.5), 12)], [("r", at(4), 30), ("r", at(1), 5), ("q", at(0), 7)], [("r", at(5), 3), ("r", at(6), 8), ("q", None, 1)]]
    got = [r for rows in play(spark, tmp_path, batches, "run_id string, ts timestamp, finished long", K.rates) for r in rows]
    assert {(r[0], (r[1] - T0).total_seconds()): r[3] for r in got} == {("r", 0.0): 0.0, ("r", 2.0): 5.0, ("r", 2.5): 5.0, ("r", 4.0): 10.0, ("r", 1.0): 5.0, ("q", 0.0): 0.0, ("r", 5.0): 0.0, ("r", 6.0): 5.0}
