import datetime

from webstrata.streaming import ingest as I


def test_url_stream_and_upserts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("a.com\n# no\nb.com\n")
    q = I.stream_urls(spark, str(src)).writeStream.format("memory").queryName("urls_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("urls_seen").count() == 2
    obs = tmp_path / "obs"
    schema = "id long, k string, at long"
    for n, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(3, "a", 2), (4, "b", 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(obs))
        stream = spark.readStream.schema(schema).parquet(str(obs))
        I.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["at", "id"], part="k").awaitTermination()
        table = sorted((r.k, r.id) for r in I.current(spark, str(tmp_path / "t"), n + 1).collect())
    assert table == [("a", 3), ("b", 2)]
    # a batch leaves the folders of other runs alone
    spark.createDataFrame([(9, "c", 5), (10, None, 5)], schema).coalesce(1).write.mode("append").parquet(str(obs))
    I.upsert_stream(spark.readStream.schema(schema).parquet(str(obs)), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["at", "id"], part="k").awaitTermination()
    assert sorted(f.name for f in (tmp_path / "t" / f"{I.VERSION}=2").iterdir() if f.is_dir()) == [f"{I.FOLDER}=none", f"{I.FOLDER}=of-c"]
    assert sorted(r.id for r in I.current(spark, str(tmp_path / "t"), 3).collect()) == [2, 3, 9, 10]
    assert sorted(r.id for r in I.current(spark, str(tmp_path / "t"), 1).collect()) == [1, 2]


def test_token_bucket_matches_a_simulation(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 5000)) for i in range(200)]
    want = {}
    for key in "ab":
        tokens, last = 3.0, 0.0  # a bucket that holds 3 and gets 4 a second
        for at, i in sorted((at, i) for i, k, at in rows if k == key):
            now = max(float(at), last)
            tokens = min(3.0, tokens + (now - last) * 4 / 1000)
            if tokens < 1:
                now += (1 - tokens) * 250
                tokens = 1.0
            tokens, last = tokens - 1, now
            want[i] = now
    got = {r.id: r.start_ms for r in I.released(spark.createDataFrame(rows, "id long, k string, at long"), "k", "at", 4, 3).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_windows_and_counters(spark):
    t0 = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t0), (1, t0 + datetime.timedelta(milliseconds=500)), (1, t0 + datetime.timedelta(minutes=9))], "u long, ts timestamp")
    assert sorted(r.n for r in I.throughput(ev).collect()) == [1, 2] and sorted(r.n for r in I.sessions(ev, "u").collect()) == [1, 2]
    p = I.progress(100, 10, 5, 5, 30, 10.0, 4.0)
    assert (p["finished"], p["active"], p["pending"], p["percent"], p["rate"], p["eta_seconds"]) == (20, 10, 70, 20.0, 2.0, 20.0)
    assert [I.phase(False, 1), I.phase(True, 1), I.phase(True, 0)] == ["running", "draining", "finalizing"]
    chains = spark.createDataFrame([(1, 1, "http://a"), (1, 2, "https://a"), (2, 1, "https://b"), (3, 1, "https://c"), (3, 2, "https://d"), (3, 3, "https://e")], "url_status_id long, sequence_order int, redirect_url string")
    assert tuple(I.chain_counters(chains).first()) == (2, 1, 1)
    assert I.fresh(spark.createDataFrame([(1, 0), (2, 90)], "k int, fetched_at_ms long"), 100, 50).count() == 1


def test_metrics_and_runs(spark):
    from webstrata.operators import runs as R
    from webstrata.streaming import metrics as M

    row = M.timing_averages(spark.createDataFrame([(10, 1), (15, 2)], "a long, b long"), ["a", "b"]).first()
    assert (row.n, row.a_sum, row.a_avg, row.b_avg) == (2, 25, 12, 1) and abs(row.a_percent + row.b_percent - 100) < 1e-9
    assert M.prometheus({"urls_total": 3, "rate": 1.5}, labels={"run": "r"}) == '# TYPE webstrata_urls_total counter\nwebstrata_urls_total{run="r"} 3\n# TYPE webstrata_rate gauge\nwebstrata_rate{run="r"} 1.5\n'
    failures = spark.createDataFrame([("DNS MX lookup error",), ("odd",), (None,), ("Process URL timeout",), ("Too many requests",)], "error_type string")
    assert M.error_counts(failures).first().asDict() == {"timeout": 1, "connection_error": 0, "http_error": 1, "dns_error": 1, "tls_error": 0, "parse_error": 0, "other_error": 2, "total": 5}
    state = M.status(100, 30, 10, 5, 5, 10.0, 4.0, errors={"timeout": 2, "dns_error": 1}, warnings={"missing_title": 1}, current_rps=15, timing={"count": 2, "averages": {"total_ms": 7}})
    assert (state["active_urls"], state["pending_urls"], state["percentage_dispatched"], state["eta_seconds"], state["errors"]["total"], state["info"]["total"]) == (10, 70, 30.0, 20.0, 3, 0)
    text = M.metrics_text(state, 'r"1', 5.0, "x")
    names = {line.split()[2] for line in text.splitlines() if line.startswith("# TYPE")}
    assert len(names) == 24 and 'x_run_info{run_id="r\\"1"} 1' in text and "x_errors_total 3" in text and "x_timing_total_ms 7" in text and 'x_phase{phase="running"} 1' in text and "# TYPE x_errors_total counter" in text
    table = R.begin(R.begin(None, spark, "r1", 1000), spark, "r2", 2000)
    facts = spark.createDataFrame([("r2",), ("r2",), ("r1",)], "run_id string")
    done = {r.run_id: r for r in R.finish(table, "r2", 5000, facts, facts.where("run_id = 'r1'"), 1).collect()}
    assert (done["r2"].total_urls, done["r2"].elapsed_seconds, done["r2"].end_time_ms, done["r1"].end_time_ms) == (3, 3.0, 5000, None)


def test_counters_come_with_the_write(spark, tmp_path):
    """A table is written and counted in one job; a stream's batches bring their counters."""
    from webstrata.streaming import metrics as M

    failures = spark.createDataFrame([("DNS MX lookup error",), ("odd",), (None,), ("Process URL timeout",)], "error_type string")
    rows, seen = M.with_error_counters(failures)
    sc = spark.sparkContext
    sc.setJobGroup("counted", "one job")
    rows.write.parquet(str(tmp_path / "f"))
    assert len(sc.statusTracker().getJobIdsForGroup("counted")) == 1
    sc.setJobGroup("after", "reading counters starts none")
    assert seen.get == {"timeout": 1, "connection_error": 0, "http_error": 0, "dns_error": 1, "tls_error": 0, "parse_error": 0, "other_error": 2, "total": 4}
    assert len(sc.statusTracker().getJobIdsForGroup("after")) == 0
    facts = spark.createDataFrame([("a", "a", 200, "t"), ("a", "b", 403, " "), ("c", None, 403, None)], "initial_domain string, final_domain string, http_status int, title string")
    rows, seen = M.with_info_counters(facts)
    assert rows.count() == 3 and seen.get == {"total": 3, "bot_detection_403": 2, "moved_domains": 1, "missing_title": 2}
    stream, _ = M.with_error_counters(spark.readStream.schema("error_type string").parquet(str(tmp_path / "f")))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sum(p.observedMetrics["errors"]["total"] for p in q.recentProgress if "errors" in p.observedMetrics) == 4
