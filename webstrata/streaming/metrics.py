"""Metrics of runs and streams: averages of timings, counters as Prometheus text, and a listener that gathers progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def timing_averages(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each timing its sum, its average cut to a whole number, and its share of all of them in percent; one row."""
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_sum") for c in columns])
    total = F.greatest(sum((F.col(f"{c}_sum") for c in columns), F.lit(0)), F.lit(1))
    each = [x for c in columns for x in (F.col(f"{c}_sum"), F.expr(f"`{c}_sum` div greatest(n, 1)").alias(f"{c}_avg"), (100.0 * F.col(f"{c}_sum") / total).alias(f"{c}_percent"))]
    return sums.select("n", *each)


#: Error types by bucket; fixed values. Types of no bucket count as other.
BUCKETS = {
    "timeout": ["Process URL timeout", "HTTP request timeout error"],
    "connection_error": ["HTTP request connect error"],
    "http_error": ["HTTP request status error", "Too many requests", "Bot detection (403 Forbidden)", "Bad Request (400)", "Unauthorized (401)", "Not Found (404)", "Internal Server Error (500)", "Bad Gateway (502)", "Service Unavailable (503)", "Gateway Timeout (504)"],
    "dns_error": ["DNS forward lookup error", "DNS NS lookup error", "DNS TXT lookup error", "DNS MX lookup error", "DNS CNAME lookup error", "DNS AAAA lookup error", "DNS CAA lookup error"],
    "tls_error": ["TLS certificate error"],
    "parse_error": ["HTTP request decode error"],
}


def error_counts(failures: DataFrame, *keys: str, error: str = "error_type") -> DataFrame:
    """Failures by bucket, those of no bucket as other_error, and in total; one row, or one for each value of keys."""
    return failures.groupBy(*keys).agg(*error_counters(error))


def error_counters(error: str = "error_type") -> list[Column]:
    """The counters as aggregates, for a table's own query or to be observed while it is written."""
    named = F.col(error).isin([x for types in BUCKETS.values() for x in types])
    counts = [F.count_if(F.col(error).isin(types)).alias(bucket) for bucket, types in BUCKETS.items()]
    return [*counts, F.count_if(~F.coalesce(named, F.lit(False))).alias("other_error"), F.count("*").alias("total")]


def observed(rows: DataFrame, name: str, *counters: Column) -> tuple[DataFrame, Observation]:
    """rows as they are, and what comes to hold the counters once any action has read them: a write and its counters are one job, and
    no row is read twice. In a stream the counters of each batch come with its progress, under the name."""
    seen = Observation(name)
    return (rows.observe(name, *counters) if rows.isStreaming else rows.observe(seen, *counters)), seen


def with_error_counters(failures: DataFrame, error: str = "error_type") -> tuple[DataFrame, Observation]:
    """Failures with their counters by bucket."""
    return observed(failures, "errors", *error_counters(error))


def with_info_counters(url_status: DataFrame) -> tuple[DataFrame, Observation]:
    """Observations with counters of answers: all, 403, on another domain than the first, without a title."""
    moved = F.coalesce(F.col("initial_domain") != F.col("final_domain"), F.lit(False))
    return observed(url_status, "info", F.count("*").alias("total"), F.count_if(F.col("http_status") == 403).alias("bot_detection_403"), F.count_if(moved).alias("moved_domains"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("missing_title"))


def info_counts(url_status: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: redirects (as chain_counters has them) and pages that answered 403."""
    from webstrata.streaming.ingest import chain_counters

    blocked = url_status.agg(F.count_if(F.col("http_status") == 403).alias("bot_detection_403"))
    return chain_counters(chains).join(F.broadcast(blocked))  # a row each


def status(total: int, attempted: int, ok: int, failed: int, skipped: int, elapsed_s: float, recent_rate: float = 0.0, phase: str = "running", errors: dict | None = None, warnings: dict | None = None, info: dict | None = None, timing: dict | None = None, **settings) -> dict:
    """The state of a run as nested values for JSON: progress, rates, counters by kind, and averages of timings where there are any."""
    finished, left = ok + failed + skipped, max(0, total - ok - failed - skipped)
    rate = finished / elapsed_s if elapsed_s > 0 else 0.0
    speed = recent_rate or rate
    eta = 0.0 if not left and total else left / speed if left and speed > 0 else None
    counted = lambda x: {**(x or {}), "total": (x or {}).get("total", sum((x or {}).values()))}
    return {
        "total_urls": total, "total_urls_attempted": attempted, "successful_urls": ok, "failed_urls": failed, "skipped_urls": skipped, "active_urls": max(0, attempted - finished), "pending_urls": max(0, total - attempted),
        "percentage_complete": 100.0 * finished / total if total else 0.0, "percentage_dispatched": 100.0 * attempted / total if total else 0.0, "elapsed_seconds": elapsed_s, "rate_per_second": rate, "windowed_rate_per_second": recent_rate, "eta_seconds": eta, "phase": phase,
        "current_rps": settings.get("current_rps"), "concurrency_limit": settings.get("concurrency_limit"), "concurrency_in_use": settings.get("concurrency_in_use"), "retried_requests": settings.get("retried_requests", 0), "non_retriable_failures": settings.get("non_retriable_failures", 0),
        "errors": counted(errors), "warnings": counted(warnings), "info": counted(info), "timing": timing,
    }


#: Names of the text format for what status() has under other names; fixed values.
GAUGES = {"total_urls_attempted": "attempted_urls", "retried_requests": "runtime_retries_total", "non_retriable_failures": "runtime_non_retriable_failures_total"}
PHASES = {"running": 1, "draining": 2, "finalizing": 3}


def metrics_text(state: dict, run_id: str = "", start_s: float = 0.0, prefix: str = "webstrata") -> str:
    """All of status() as gauges and counters in the text format; missing values are zero."""
    flat = {GAUGES.get(k, k): v or 0 for k, v in state.items() if not isinstance(v, dict) and k not in ("phase", "pending_urls", "timing")}
    flat |= {"start_time_seconds": start_s} | {f"{k}_total": state[k]["total"] for k in ("errors", "warnings", "info")}
    flat |= {f"timing_{k}": v for k, v in (state.get("timing") or {}).get("averages", {}).items()}
    label = run_id.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    phase = state["phase"]
    return prometheus({"run_info": 1}, prefix, {"run_id": label}) + prometheus({"phase": PHASES.get(phase, 1)}, prefix, {"phase": phase}) + prometheus(flat, prefix)


def prometheus(counters: dict[str, float], prefix: str = "webstrata", labels: dict[str, str] | None = None) -> str:
    """Counters and gauges in the text format; names that end in _total are counters."""
    tags = "{" + ",".join(f'{k}="{v}"' for k, v in sorted((labels or {}).items())) + "}" if labels else ""
    lines = []
    for name, value in counters.items():
        lines += [f"# TYPE {prefix}_{name} {'counter' if name.endswith('_total') else 'gauge'}", f"{prefix}_{name}{tags} {value:g}"]
    return "\n".join(lines) + "\n"


class Progress(StreamingQueryListener):
    """The latest figures of each query, for prometheus()."""

    def __init__(self):
        self.latest: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event):
        self.latest.setdefault(str(event.id), {"input_rows_total": 0.0})

    def onQueryProgress(self, event):
        p, own = event.progress, self.latest.setdefault(str(event.progress.id), {"input_rows_total": 0.0})
        own |= {"input_rows_total": own["input_rows_total"] + p.numInputRows, "input_rows_per_second": p.inputRowsPerSecond, "processed_rows_per_second": p.processedRowsPerSecond, "batch": float(p.batchId)}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
