import json

import pytest
from pyspark.sql import functions as F

from webstrata.operators import export as E
from webstrata.operators import upsert as U
from webstrata.plans import summary
from webstrata.plans.bridge import Star
from webstrata.sources import tables, urls

FACT = "id long, initial_domain string, final_domain string, ip_address string, http_status int, http_status_text string, response_time_seconds double, title string, observed_at_ms long, run_id string"


def minimal(spark):
    return spark.createDataFrame([(1, "snapshot.example.com", "snapshot.example.com", "192.0.2.1", 200, "OK", 1.5, "Test, \"Page\"", 1704067200000, "run_1")], FACT)


def test_minimal_exports(spark, tmp_path):
    rows = E.wide({"url_status": minimal(spark)})
    flat = E.flat(rows).first().asDict()
    assert len(flat) == 83 and flat["url"] == "https://snapshot.example.com" and flat["response_time_ms"] == "1.50" and flat["technology_count"] == "0" and flat["ssl_cert_valid_to"] == ""
    doc = json.loads(E.json_lines(rows).first()[0])
    assert doc["geoip"] is None and doc["whois"] is None and doc["dns"]["mx_records"] == [] and doc["tls"]["certificate"] == {"subject": None, "issuer": None, "valid_to": None, "sans": [], "san_count": 0, "oids": []} and doc["favicon"] == {"hash": None, "url": None} and doc["response_time_ms"] == 1.5
    assert len(E.parquet_rows(rows).columns) == 67
    E.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()["title"] == 'Test, "Page"'
    E.write_jsonl(rows, str(tmp_path / "j"))
    E.write_parquet(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and spark.read.text(str(tmp_path / "j")).count() == 1


def test_satellites_are_sorted_capped_and_counted(spark):
    sd = spark.range(600).select(F.lit(1).alias("url_status_id"), F.lit("json_ld").alias("data_type"), F.lit("").alias("property_name"), F.format_string("%04d", 599 - F.col("id")).alias("property_value"))
    tech = spark.createDataFrame([(1, "b", None, "C", False), (1, "a", "1", None, None), (1, "z", None, None, True)], "url_status_id long, technology_name string, technology_version string, technology_category string, is_implied boolean")
    secret = spark.createDataFrame([(9, 1, "jwt", "v", "high", "html_body", "c")], "id long, url_status_id long, secret_type string, matched_value string, severity string, location string, context string")
    claims = spark.createDataFrame([(9, "HS256", "me", 5)], "exposed_secret_id long, algorithm string, issuer string, expiration_ms long")
    t = {"url_status": minimal(spark), "url_structured_data": sd, "url_technologies": tech, "url_exposed_secrets": secret, "url_jwt_claims": claims}
    rows = E.wide(t)
    r = rows.first()
    assert len(r.structured_data) == 500 and r.structured_data[0].property_value == "0000" and r.structured_data_count == 600
    flat = E.flat(rows).first()
    assert flat.technologies == "a:1,b:" and flat.technology_categories == "C" and flat.exposed_secrets == "[high] jwt|html_body|v|alg=HS256|iss=me"
    assert E.flat(E.wide(t, include_implied=True)).first().technology_count == "3"
    assert json.loads(E.json_lines(rows).first()[0])["exposed_secrets"][0]["jwt_claims"]["expiration_ms"] == 5
    assert E.wide(t, run_id="x").count() == 0 and E.wide(t, domain="snapshot.example.com", status=200, since_ms=1).count() == 1


def test_upsert(spark):
    rows = spark.createDataFrame([(1, "r", "a", 1, "x"), (2, "r", "a", 5, "y"), (3, "r", "b", 2, "z"), (4, None, "a", 1, "p"), (5, None, "a", 2, "q")], "id long, run_id string, d string, at long, v string")
    won = U.latest(rows, ["run_id", "d"], ["at", "id"])
    assert sorted(r.id for r in won.collect()) == [2, 3, 4, 5]
    sat = spark.createDataFrame([(1, "s"), (2, "t")], "url_status_id long, n string")
    assert [r.n for r in U.satellites_of(won, sat).collect()] == ["t"]
    cookies = spark.createDataFrame([(1, "c", True, "/a", 1), (1, "c", False, "/b", 2)], "k long, name string, secure boolean, path string, seq int")
    assert tuple(U.merge_columns(cookies, ["k", "name"], ["seq"], ["secure"]).first()) == (1, "c", "/a", False)
    assert U.first_per_key(cookies, ["k", "name"], ["seq"]).first().path == "/a" and U.drop_runs(rows, ["r"]).count() == 2


def test_tables_and_urls(spark, tmp_path):
    a = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    tables.write_table(a, str(tmp_path), "t")
    tables.write_table(a.where("n = 2").withColumn("n", F.lit(5)), str(tmp_path), "t")
    assert sorted((r.run_id, r.n) for r in tables.read_table(spark, str(tmp_path), "t").collect()) == [("r1", 1), ("r2", 5)]
    f = tmp_path / "u.txt"
    f.write_text("# c\n\n example.com \nhttp://10.0.0.1/\nftp://x\n")
    got = {r.line: (r.url, r.domain, r.allowed) for r in urls.read_urls(spark, str(f)).collect()}
    assert got == {"example.com": ("https://example.com", "example.com", True), "http://10.0.0.1/": ("http://10.0.0.1/", "10.0.0.1", False), "ftp://x": (None, None, False)} and urls.count_urls(spark, str(f)) == 3


def test_a_run_is_committed_whole_or_not_at_all(spark, tmp_path):
    root, n = str(tmp_path), lambda name: sorted(r.n for r in tables.read_runs(spark, str(tmp_path), name).collect())
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "n int")
    broken = rows(1).selectExpr("raise_error('no') AS n")
    assert tables.write_run(spark, {"url_status": rows(1, 2), "extra": rows(7)}, root, "r1") == ["url_status", "extra"]
    tables.write_run(spark, {"url_status": rows(5)}, root, "r2")
    assert n("url_status") == [1, 2, 5] and n("extra") == [7]
    with pytest.raises(Exception, match="no"):
        tables.write_run(spark, {"url_status": broken, "extra": rows(8)}, root, "r1")
    assert n("url_status") == [1, 2, 5] and n("extra") == [7]
    assert tables.write_run(spark, {"url_status": rows(3), "extra": broken}, root, "r1") == ["url_status"]
    assert n("url_status") == [3, 5] and tables.read_runs(spark, root, "extra") is None


def test_summary(spark):
    s = Star(spark, "/root/testdata/sf0.001")
    text = summary.text_digest(s.runs, s.url_status, s.url_technologies, s.url_exposed_secrets)
    assert text.startswith(f"Run {summary.run_history(s.runs, 1).first().run_id}:") and "Secrets:" in text
    assert summary.resolve_run(s.runs, s.runs.agg(F.max("run_id")).first()[0])["end_time_ms"] is None
