"""The star schema at rest: Parquet folders, partitioned by run."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)

#: Column types of the main tables (the satellites' are in operators.export.SATELLITES).
SCHEMAS = {
    "runs": "run_id string, version string, fingerprints_source string, fingerprints_version string, geoip_version string, start_time_ms long, end_time_ms long, elapsed_seconds double, total_urls int, successful_urls int, failed_urls int, skipped_urls int",
    "url_failures": "id long, attempted_url string, final_url string, initial_domain string, final_domain string, error_type string, error_message string, http_status int, retry_count int, elapsed_time_seconds double, observed_at_ms long, run_id string",
    "url_partial_failures": "url_status_id long, error_type string, error_message string, observed_at_ms long, run_id string",
    "url_jwt_claims": "exposed_secret_id long, header_json string, payload_json string, algorithm string, token_type string, issuer string, subject string, audience string, expiration_ms long, issued_at_ms long, not_before_ms long, jwt_id string",
}


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Overwrite the partitions (runs) that df has; others stay. Repeating a write gives the same table."""
    by_run = "run_id" in df.columns
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("run_id") if by_run else writer).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


#: The table of what has been committed: a row a written version of a run.
COMMITS = "_commits"


def write_run(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str, needed: tuple[str, ...] = ("url_status",)) -> list[str]:
    """All tables of one run, seen together or not at all: they go into a version of their own, and one small row, written last, makes that
    the run's version. If one of `needed` fails, nothing is committed and the version that was there stays; of other tables a failure is
    logged and the table left out. Returns the names that were written."""
    version, done = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex}", []
    for name, df in sorted(tables.items(), key=lambda x: x[0] not in needed):
        try:
            df.write.parquet(f"{root}/{version}/{name}")
            done.append(name)
        except PySparkException:
            if name in needed:
                raise
            LOG.warning("%s of run %s was not written", name, run_id, exc_info=True)
    spark.createDataFrame([(run_id, version, done)], "run_id string, version string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")
    return done


def read_runs(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table over the committed versions of all runs, None where no run has it; commits are a row a run and version."""
    commits = spark.read.parquet(f"{root}/{COMMITS}")
    last = commits.groupBy("run_id").agg(F.max_by(F.struct("version", "tables"), "version").alias("last")).select("last.*").collect()
    paths = [f"{root}/{r['version']}/{name}" for r in last if name in r["tables"]]
    return spark.read.parquet(*paths) if paths else None


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
