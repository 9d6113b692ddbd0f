"""The run dimension: a run is begun, counted as its rows come in, and finished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.sources.tables import SCHEMAS


def begin(runs: DataFrame | None, spark, run_id: str, start_ms: int, version: str = "", **more) -> DataFrame:
    """The runs with one that is open; beginning a run again resets it."""
    row = spark.createDataFrame([{"run_id": run_id, "start_time_ms": start_ms, "version": version, "skipped_urls": 0, **more}], SCHEMAS["runs"])
    return row if runs is None else runs.where(F.col("run_id") != run_id).unionByName(row)


def finish(runs: DataFrame, run_id: str, end_ms: int, url_status: DataFrame, failures: DataFrame, skipped: int = 0) -> DataFrame:
    """The runs with one closed: counts come from the facts of the run. An unknown run changes nothing."""
    ok, bad = url_status.where(F.col("run_id") == run_id).count(), failures.where(F.col("run_id") == run_id).count()
    mine = F.col("run_id") == run_id
    new = {"end_time_ms": F.lit(end_ms).cast("long"), "elapsed_seconds": (F.lit(end_ms) - F.col("start_time_ms")) / 1000.0, "total_urls": F.lit(ok + bad + skipped), "successful_urls": F.lit(ok), "failed_urls": F.lit(bad), "skipped_urls": F.lit(skipped)}
    return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})
