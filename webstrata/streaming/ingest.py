"""Streams: URL lists as they arrive, upserts by micro-batch, throughput and sessions. What needs keyed state is in state.py."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webstrata.operators.upsert import latest
from webstrata.sources.urls import described, lines


def stream_urls(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder as described URLs; the number of files a trigger bounds what is in flight."""
    return described(lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)))


def upsert_stream(observations: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], part: str = "run_id") -> StreamingQuery:
    """Keep the latest observation of each key in a table with a folder a value of `part`, which is one of the keys. A batch rewrites only
    the folders of the values that it holds, each in a version of its own; replaying a batch gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        rows, old = with_folder(batch, part), stored(batch.sparkSession, path, number)
        names = [r[FOLDER] for r in rows.select(FOLDER).distinct().collect()]  # the runs of a batch
        if old is not None:
            rows = rows.unionByName(with_folder(old.where(F.col(FOLDER).cast("string").isin(names)).drop(FOLDER), part))
        latest(rows, keys, order).write.mode("overwrite").partitionBy(FOLDER).parquet(f"{path}/{VERSION}={number}")

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VERSION, FOLDER = "_version", "_folder"


def with_folder(rows: DataFrame, part: str) -> DataFrame:
    return rows.withColumn(FOLDER, F.coalesce(F.concat(F.lit("of-"), F.col(part).cast("string")), F.lit("none")))


def stored(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Of each folder its rows in the last version under `before`, with the folder's name; None where nothing is stored."""
    try:
        rows = spark.read.option("basePath", path).parquet(path).where(F.col(VERSION) < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = rows.groupBy(FOLDER).agg(F.max(VERSION).alias(VERSION))  # a row a run, from folder names
    return rows.join(F.broadcast(newest), [FOLDER, VERSION]).drop(VERSION)


def current(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The table after so many batches."""
    return stored(spark, path, batches).drop(FOLDER)


def throughput(events: DataFrame, ts: str = "ts", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Events a window; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def released(requests: DataFrame, key: str, ts_ms: str, per_second: int, burst: int) -> DataFrame:
    """requests with start_ms, when a token bucket of each key lets them go: `burst` at once, then one every 1000 / per_second ms.

    A bucket's next free moment is the greatest, over the requests so far, of arrival plus one interval for each request since;
    so it is a running maximum, and no state is kept row by row."""
    interval = 1000.0 / per_second
    order = Window.partitionBy(key).orderBy(ts_ms, *(c for c in requests.columns if c not in (key, ts_ms)))
    n = F.row_number().over(order).cast("double")
    rows = requests.withColumn("_n", n)
    free = F.max(F.col(ts_ms) - (F.col("_n") - 1) * interval).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + (F.col("_n") - 1) * interval
    return rows.withColumn("start_ms", F.greatest(F.col(ts_ms).cast("double"), free - (burst - 1) * interval)).drop("_n")


def progress(total: int, ok: int, failed: int, skipped: int, started: int, elapsed_s: float, recent_rate: float | None = None) -> dict:
    """A snapshot of a run's counters: finished, active, pending, percent, rate and seconds to go (the recent rate is preferred)."""
    finished = ok + failed + skipped
    rate = finished / elapsed_s if elapsed_s > 0 else 0.0
    speed = recent_rate if recent_rate else rate
    left = max(0, total - finished)
    return {"finished": finished, "active": max(0, started - finished), "pending": max(0, total - max(started, finished)), "percent": 100.0 * finished / total if total else 0.0, "rate": rate, "eta_seconds": left / speed if speed > 0 else None}


def phase(draining: bool, in_flight: int) -> str:
    return "running" if not draining else "draining" if in_flight else "finalizing"


def fresh(table: DataFrame, now_ms: int, ttl_ms: int, stamp: str = "fetched_at_ms") -> DataFrame:
    """The rows of a cache table that haven't expired."""
    return table.where(F.col(stamp) + ttl_ms > now_ms)


def chain_counters(chains: DataFrame) -> DataFrame:
    """Counters from redirect chains: any redirect, more than two hops, a step from http to https."""
    hops = chains.groupBy("url_status_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("sequence_order", "redirect_url"))).alias("c"))
    https = F.get("c", F.lit(0))["redirect_url"].startswith("http://") & F.element_at("c", -1)["redirect_url"].startswith("https://")
    return hops.agg(F.count_if(F.col("n") > 1).alias("http_redirect"), F.count_if(F.col("n") > 2).alias("multiple_redirects"), F.count_if((F.col("n") > 1) & https).alias("https_redirect"))
