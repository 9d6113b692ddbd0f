"""The digest of a run: status counts, top observed technologies, secret counts; and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 15


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed runs, latest first."""
    done = runs.where(F.col("end_time_ms").isNotNull()).orderBy(F.desc("start_time_ms"), "run_id")
    return done if limit is None else done.limit(limit)


def resolve_run(runs: DataFrame, run_id: str | None = None):
    """The row of a run: the named one, finished or not, or else the latest completed one."""
    row = runs.where(F.col("run_id") == run_id).first() if run_id is not None else run_history(runs, 1).first()
    if row is None:
        raise ValueError(f"no run {run_id!r}" if run_id is not None else "no completed run")
    return row


def status_counts(url_status: DataFrame, run_id: str) -> DataFrame:
    return url_status.where(F.col("run_id") == run_id).groupBy("http_status").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "http_status")


def top_technologies(url_status: DataFrame, technologies: DataFrame, run_id: str, limit: int = TOP) -> DataFrame:
    """Observed (not merely implied) technologies by the number of URLs; a limit of 0 means the default."""
    ids = url_status.where(F.col("run_id") == run_id).select(F.col("id").alias("url_status_id"))
    seen = technologies.where(~F.coalesce("is_implied", F.lit(False))).join(ids, "url_status_id", "left_semi")
    return seen.groupBy(F.col("technology_name").alias("name")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "name").limit(limit or TOP)


def secret_stats(url_status: DataFrame, secrets: DataFrame, run_id: str) -> DataFrame:
    ids = url_status.where(F.col("run_id") == run_id).select(F.col("id").alias("url_status_id"))
    return secrets.join(ids, "url_status_id", "left_semi").agg(F.count("*").alias("secret_count"), F.count_distinct("url_status_id").alias("urls_with_secrets"))


def text_digest(runs: DataFrame, url_status: DataFrame, technologies: DataFrame, secrets: DataFrame, run_id: str | None = None, limit: int = TOP) -> str:
    """The report as text; each part is a small aggregate."""
    run = resolve_run(runs, run_id)
    lines = [f"Run {run['run_id']}: {run['total_urls']} URLs, {run['successful_urls']} captured, {run['failed_urls']} failed, {run['skipped_urls']} skipped", "", "Statuses:"]
    lines += [f"  {r['cnt']:>6}  {r['http_status']}" for r in status_counts(url_status, run["run_id"]).collect()]
    lines += ["", "Technologies seen most:"] + ([f"  {r['cnt']:>6}  {r['name']}" for r in top_technologies(url_status, technologies, run["run_id"], limit).collect()] or ["  none"])
    s = secret_stats(url_status, secrets, run["run_id"]).first()
    return "\n".join([*lines, "", f"Secrets: {s['secret_count']} on {s['urls_with_secrets']} URLs", ""])
