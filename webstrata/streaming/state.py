"""Keyed state of streams: time-outs of attempts, a bounded cache with expiry, and throughput of counters.

Each is a stateful processor of transformWithState: state lies in RocksDB by key, beside the checkpoint, so a lost executor's
keys go on elsewhere from the last batch. What time decides is decided by the events' own time, by timers that fire once
the watermark has passed them; the same events give the same rows however they are cut into batches, as long as none is
later than the watermark allows. State that nobody asks for any more goes by timers too. (The state's own expiry counts
processing time, and a stream that uses it never comes to an end with all that is available, so it isn't used.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT_ERROR = "Process URL timeout"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """The rows a processor makes of a stream's rows with the same key. Rows have their time as ts and, in ms, as at."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one store that has timers
    timed = rows.where("ts IS NOT NULL").withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def only_timer(handle: StatefulProcessorHandle, at: int, now: int) -> None:
    """One timer for a key, in the place of those it has."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(max(at, now + 1))


# --- time-outs --------------------------------------------------------------------------------------------------------

FAILURES = "url string, error_type string, error_message string, started_at_ms long, failed_at_ms long"


class TimeOuts(StatefulProcessor):
    """An attempt is open from its earliest start until an end at or after it, or until the limit has passed."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "began long, ended long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        began, ended = self.seen.get() if self.seen.exists() else (None, None)
        for df in rows:
            for kind, at in zip(df["state"], df["at"].tolist(), strict=True):
                if kind == "start" and (began is None or at < began):
                    began = at
                elif kind == "end" and (ended is None or at > ended):
                    ended = at
        if began is not None and ended is not None and ended >= began:  # done; the end is kept until no late start can come before it
            began = None
        if began is None and ended is None:
            return iter(())
        self.seen.update((began, ended))
        only_timer(self.handle, (began if began is not None else ended) + self.limit, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began = self.seen.get()[0] if self.seen.exists() else None
        self.seen.clear()
        if began is not None:
            message = f"no end within {self.limit / 1000:g} s"
            yield pd.DataFrame([(key[0], TIMEOUT_ERROR, message, began, began + self.limit)], columns=["url", "error_type", "error_message", "started_at_ms", "failed_at_ms"])


def timed_out(attempts: DataFrame, limit_ms: int = 35_000, late: str = "10 seconds") -> DataFrame:
    """Attempts (url, state 'start' or 'end', ts) that had no end within the limit, as failures, once the watermark has passed it.

    Starts that repeat count once, from the earliest; an end that comes before its start closes it too. Events later than the
    watermark are dropped by the stream. A start after a failure opens a new attempt. Rows of a null url are one attempt."""
    return with_state(attempts.select("url", "state", F.col("ts").cast("timestamp").alias("ts")), "url", TimeOuts(limit_ms), FAILURES, late)


# --- a cache ----------------------------------------------------------------------------------------------------------

ANSWERS = "key string, ts timestamp, hit boolean, value string"


class Cache(StatefulProcessor):
    """The entries of one part of the keys: the newest `most`, each for `ttl_ms` from the moment it was fetched."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, at long")
        self.size = handle.getValueState("size", "n int")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        # an answer counts for questions of its own moment
        df = df.assign(question=df["fetched"].eq(False)).sort_values(["at", "question", "key", "value"], kind="stable")
        out, added = [], 0
        for name, value, fetched, ts, at in zip(df["key"], df["value"], df["fetched"], df["ts"], df["at"], strict=True):
            known = (self.entries.getValue((name,)) if self.entries.containsKey((name,)) else None)
            if fetched:
                if known is None or known[1] <= at:  # an answer older than the one that is known changes nothing
                    self.entries.updateValue((name,), (value, at))
                    added += known is None
            else:
                hit = known is not None and known[1] <= at < known[1] + self.ttl
                out.append((name, ts, hit, known[0] if hit else None))
        if added:
            self.evict(added)
            only_timer(self.handle, int(df["at"].max()) + self.ttl, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Entries that have expired go, once the watermark has passed the newest one or comes back for the rest."""
        now = timerValues.getCurrentWatermarkInMs()
        every = [(name[0], value[1]) for name, value in self.entries.iterator()]
        left = [at for _, at in every if at + self.ttl > now]
        for name, at in every:
            if at + self.ttl <= now:
                self.entries.removeKey((name,))
        self.size.update((len(left),))
        if left:
            self.handle.registerTimer(max(left) + self.ttl)
        return iter(())

    def evict(self, added: int) -> None:
        """Past the limit the oldest entries go; a tenth more than needed, so that this is rare."""
        n = (self.size.get()[0] if self.size.exists() else 0) + added
        if n > self.most:
            every = sorted((value[1], name[0]) for name, value in self.entries.iterator())
            keep = max(1, self.most - self.most // 10)
            gone = [name for _, name in every[: len(every) - keep]]
            for name in gone:
                self.entries.removeKey((name,))
            n = len(every) - len(gone)
        self.size.update((n,))


def cached(questions: DataFrame, answers: DataFrame, most: int = 50_000, ttl_ms: int = 7 * 86_400_000, parts: int = 64, late: str = "1 minute") -> DataFrame:
    """Questions (key, ts) with hit and value, from the answers (key, value, ts) that came at or before them and have not expired.

    Keys are dealt out to `parts` caches of most / parts entries (one at least); where one is full, its oldest entries go. Null
    keys and times are left out. Both sides may be streams."""
    ask = questions.select(F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("fetched"))
    tell = answers.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("fetched"))
    rows = ask.unionByName(tell).where("key IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return with_state(rows, "part", Cache(max(1, most // parts), ttl_ms), ANSWERS, late)


# --- throughput -------------------------------------------------------------------------------------------------------

RATES = "run_id string, ts timestamp, finished long, rate double"
STEP_MS, KEEP_MS = 1000, 86_400_000


class Rates(StatefulProcessor):
    """The rate of a counter between samples that lie a second apart at least; nearer ones repeat the last rate."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, finished long, rate double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        df = df.sort_values(["at", "finished"], kind="stable")
        last, out = (self.last.get() if self.last.exists() else None), []
        for ts, at, finished in zip(df["ts"], df["at"], df["finished"], strict=True):
            finished = int(finished)
            if last is None:
                last = (at, finished, 0.0)
            elif at >= last[0]:  # a sample from before the last one says nothing new
                since, grown = at - last[0], finished - last[1]
                if grown < 0:  # the counter began anew
                    last = (at, finished, 0.0)
                elif since >= STEP_MS:
                    last = (at, finished, 1000.0 * grown / since)
            out.append((key[0], ts, finished, last[2]))
        self.last.update(last)
        only_timer(self.handle, last[0] + KEEP_MS, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["run_id", "ts", "finished", "rate"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()  # a run that has said nothing for a day
        return iter(())


def rates(samples: DataFrame, late: str = "1 minute") -> DataFrame:
    """Samples (run_id, ts, finished) of runs' counters with the rate a second at that moment. A counter that falls starts anew at rate 0."""
    rows = samples.select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.col("finished").cast("long").alias("finished")).where("finished IS NOT NULL")
    return with_state(rows, "run_id", Rates(), RATES, late)
