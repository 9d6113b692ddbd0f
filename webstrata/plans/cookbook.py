"""The cookbook: relational queries over the star schema, each as a DataFrame plan and, for the oracle, as SQL.

Ties in orderings are broken by further columns, so results with a limit are defined. Concatenations have
a fixed order. "Now" is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import scalar as S
from webstrata.plans.bridge import AS_OF_MS, Star, with_tables

Plan = Callable[[Star], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}
TIME = "strftime(make_timestamp({0} * 1000), '%Y-%m-%d %H:%M:%S')"


def query(name: str, sql: str) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name], SQL[name] = plan, with_tables(sql)
        return plan

    return add


def listed(x: str, sep: str = ",") -> Column:
    """All values, in order; each once."""
    return F.array_join(F.sort_array(F.collect_set(x)), sep)


def of_status(t: Star, satellite: DataFrame) -> DataFrame:
    """A satellite's rows with their observation."""
    return satellite.join(t.url_status.withColumnRenamed("id", "url_status_id"), "url_status_id")


@query("q01_all_urls", f"SELECT initial_domain, http_status, final_domain, {TIME.format('observed_at_ms')} AS scanned_at FROM url_status")
def _(t):
    return t.url_status.orderBy(F.desc("observed_at_ms"), "initial_domain").select("initial_domain", "http_status", "final_domain", S.epoch_text("observed_at_ms").alias("scanned_at"))


@query("q02_failed_urls", f"SELECT initial_domain, error_type, error_message, {TIME.format('observed_at_ms')} AS scanned_at FROM url_failures")
def _(t):
    return t.url_failures.orderBy(F.desc("observed_at_ms"), "id").select("initial_domain", "error_type", "error_message", S.epoch_text("observed_at_ms").alias("scanned_at"))


@query("q03_redirects", "SELECT any_value(initial_domain) AS initial_domain, any_value(final_domain) AS final_domain, any_value(u.http_status) AS http_status, count(*) AS redirect_count FROM url_status u JOIN url_redirect_chain r ON u.id = r.url_status_id GROUP BY u.id")
def _(t):
    counts = t.url_redirect_chain.groupBy("url_status_id").agg(F.count("*").alias("redirect_count"))
    return of_status(t, counts).select("initial_domain", "final_domain", "http_status", "redirect_count").orderBy(F.desc("redirect_count"), "initial_domain")


@query("q04_redirect_chains", "SELECT initial_domain, redirect_url, r.http_status AS http_status, sequence_order FROM url_status u JOIN url_redirect_chain r ON u.id = r.url_status_id")
def _(t):
    return of_status(t, t.url_redirect_chain.withColumnRenamed("http_status", "hop")).orderBy("url_status_id", "sequence_order").select("initial_domain", "redirect_url", F.col("hop").alias("http_status"), "sequence_order")


@query("q05_technologies", "SELECT initial_domain, final_domain, technology_name, technology_version, technology_category FROM url_status u JOIN url_technologies t ON u.id = t.url_status_id")
def _(t):
    return t.technologies_with("initial_domain", "final_domain").orderBy("final_domain", "technology_category", "technology_name").select("initial_domain", "final_domain", "technology_name", "technology_version", "technology_category")


@query("q06_technologies_by_category", "SELECT technology_category, count(DISTINCT technology_name) AS technology_count, count(DISTINCT final_domain) AS domain_count FROM url_technologies t JOIN url_status u ON t.url_status_id = u.id GROUP BY 1")
def _(t):
    return t.technologies_with("final_domain").groupBy("technology_category").agg(F.count_distinct("technology_name").alias("technology_count"), F.count_distinct("final_domain").alias("domain_count")).orderBy(F.desc("technology_count"), "technology_category")


@query("q07_domains_with_technology", "SELECT DISTINCT final_domain, initial_domain, technology_version FROM url_status u JOIN url_technologies t ON u.id = t.url_status_id WHERE technology_name = 'Brand#13'")
def _(t):
    return t.technologies_with("initial_domain", "final_domain").where(F.col("technology_name") == "Brand#13").select("final_domain", "initial_domain", "technology_version").distinct().orderBy("final_domain")


@query("q08_certificates_expiring", f"SELECT initial_domain, final_domain, {TIME.format('ssl_cert_valid_to_ms')} AS cert_expiry, trunc((ssl_cert_valid_to_ms - {AS_OF_MS}) / 86400000.0)::INTEGER AS days_until_expiry FROM url_status WHERE (ssl_cert_valid_to_ms - {AS_OF_MS}) / 86400000.0 BETWEEN 0 AND 30")
def _(t):
    left = F.col("ssl_cert_valid_to_ms") - AS_OF_MS
    return t.url_status.where(left.between(0, 30 * S.DAY_MS)).select("initial_domain", "final_domain", S.epoch_text("ssl_cert_valid_to_ms").alias("cert_expiry"), S.days_between(F.col("ssl_cert_valid_to_ms"), F.lit(AS_OF_MS)).alias("days_until_expiry")).orderBy("days_until_expiry", "initial_domain")


@query("q09_certificates_expired", f"SELECT initial_domain, final_domain, {TIME.format('ssl_cert_valid_to_ms')} AS cert_expiry, trunc(({AS_OF_MS} - ssl_cert_valid_to_ms) / 86400000.0)::INTEGER AS days_expired FROM url_status WHERE ssl_cert_valid_to_ms < {AS_OF_MS}")
def _(t):
    return t.url_status.where(F.col("ssl_cert_valid_to_ms") < AS_OF_MS).select("initial_domain", "final_domain", S.epoch_text("ssl_cert_valid_to_ms").alias("cert_expiry"), S.days_between(F.lit(AS_OF_MS), F.col("ssl_cert_valid_to_ms")).alias("days_expired")).orderBy(F.desc("days_expired"), "initial_domain")


@query("q10_issuers", "SELECT ssl_cert_issuer, count(DISTINCT final_domain) AS domain_count FROM url_status WHERE ssl_cert_issuer IS NOT NULL GROUP BY 1")
def _(t):
    return t.url_status.where(F.col("ssl_cert_issuer").isNotNull()).groupBy("ssl_cert_issuer").agg(F.count_distinct("final_domain").alias("domain_count")).orderBy(F.desc("domain_count"), "ssl_cert_issuer")


@query("q11_dns_records", """SELECT final_domain, 'NS' AS record_type, nameserver AS record_value FROM url_status u JOIN url_nameservers n ON u.id = n.url_status_id WHERE final_domain = 'f7.example'
UNION ALL SELECT final_domain, record_type, record_value FROM url_status u JOIN url_txt_records x ON u.id = x.url_status_id WHERE final_domain = 'f7.example'
UNION ALL SELECT final_domain, 'MX', priority || ' ' || mail_exchange FROM url_status u JOIN url_mx_records m ON u.id = m.url_status_id WHERE final_domain = 'f7.example'""")
def _(t):
    one = lambda s, kind, value: of_status(t, s).where(F.col("final_domain") == "f7.example").select("final_domain", kind.alias("record_type"), value.alias("record_value"))
    ns, txt = one(t.url_nameservers, F.lit("NS"), F.col("nameserver")), one(t.url_txt_records, F.col("record_type"), F.col("record_value"))
    return ns.unionByName(txt).unionByName(one(t.url_mx_records, F.lit("MX"), F.concat_ws(" ", F.col("priority").cast("string"), "mail_exchange"))).orderBy("record_type", "record_value")


for number, column, kind in ((12, "spf_record", "SPF"), (13, "dmarc_record", "DMARC")):

    @query(f"q{number}a_{kind.lower()}_field", f"SELECT DISTINCT final_domain, {column} FROM url_status WHERE {column} IS NOT NULL")
    def _(t, column=column):
        return t.url_status.where(F.col(column).isNotNull()).select("final_domain", column).distinct().orderBy("final_domain")

    @query(f"q{number}b_{kind.lower()}_txt", f"SELECT DISTINCT final_domain, record_value AS {column} FROM url_status u JOIN url_txt_records x ON u.id = x.url_status_id WHERE record_type = '{kind}'")
    def _(t, column=column, kind=kind):
        return of_status(t, t.url_txt_records.where(F.col("record_type") == kind)).select("final_domain", F.col("record_value").alias(column)).distinct().orderBy("final_domain")


for number, name, columns in ((14, "url_cname_records", ["cname_target"]), (15, "url_ipv6_addresses", ["ipv6_address"]), (16, "url_caa_records", ["flag", "tag", "value"])):

    @query(f"q{number}_{name[4:]}", f"SELECT final_domain, {', '.join(columns)} FROM {name} r JOIN url_status u ON u.id = r.url_status_id")
    def _(t, name=name, columns=columns):
        return of_status(t, getattr(t, name)).select("final_domain", *columns).orderBy("final_domain", *columns)


for number, column, title in ((17, "body_sha256", "same_body"), (18, "cert_fingerprint_sha256", "same_fingerprint")):

    @query(f"q{number}_{title}", f"SELECT {column}, count(*) AS cnt, string_agg(final_domain, ',' ORDER BY final_domain) AS domains FROM url_status WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
    def _(t, column=column):
        return t.url_status.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("cnt"), F.array_join(F.sort_array(F.collect_list("final_domain")), ",").alias("domains")).where("cnt > 1")


@query("q17b_same_text", "SELECT sha256(text) AS body_sha256, count(*) AS cnt, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS doc_ids FROM documents WHERE strlen(text) > 0 GROUP BY 1 HAVING count(*) > 1")
def _(t):
    hashed = t.raw("documents").select(S.body_sha256("text").alias("body_sha256"), F.col("doc_id").cast("string").alias("doc")).where(F.col("body_sha256").isNotNull())
    return hashed.groupBy("body_sha256").agg(F.count("*").alias("cnt"), F.array_join(F.sort_array(F.collect_list("doc")), ",").alias("doc_ids")).where("cnt > 1")


@query("q19_http_versions", "SELECT http_version, count(*) AS cnt FROM url_status GROUP BY 1")
def _(t):
    return t.url_status.groupBy("http_version").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "http_version")


@query("q20_domains_by_country", "SELECT final_domain, initial_domain, country_code, country_name, city FROM url_status u JOIN url_geoip g ON u.id = g.url_status_id")
def _(t):
    return of_status(t, t.url_geoip).select("final_domain", "initial_domain", "country_code", "country_name", "city").orderBy("country_code", "city")


@query("q21_country_counts", "SELECT country_code, country_name, count(DISTINCT final_domain) AS domain_count FROM url_status u JOIN url_geoip g ON u.id = g.url_status_id GROUP BY 1, 2")
def _(t):
    return of_status(t, t.url_geoip).groupBy("country_code", "country_name").agg(F.count_distinct("final_domain").alias("domain_count")).orderBy(F.desc("domain_count"), "country_code")


@query("q22_runs", f"SELECT run_id, version, {TIME.format('start_time_ms')} AS started_at, elapsed_seconds, total_urls, successful_urls, failed_urls, skipped_urls FROM runs")
def _(t):
    return t.runs.orderBy(F.desc("start_time_ms")).select("run_id", "version", S.epoch_text("start_time_ms").alias("started_at"), "elapsed_seconds", "total_urls", "successful_urls", "failed_urls", "skipped_urls")


@query("q23_status_changes", "SELECT a.initial_domain, a.http_status AS status_run1, b.http_status AS status_run2 FROM url_status a JOIN url_status b ON a.final_domain = b.final_domain WHERE a.run_id = 'run_1996' AND b.run_id = 'run_1997' AND a.http_status <> b.http_status")
def _(t):
    a = t.url_status.where("run_id = 'run_1996'").select("initial_domain", "final_domain", F.col("http_status").alias("status_run1"))
    b = t.url_status.where("run_id = 'run_1997'").select("final_domain", F.col("http_status").alias("status_run2"))
    return a.join(b, "final_domain").where("status_run1 <> status_run2").select("initial_domain", "status_run1", "status_run2")


@query("q24_new_technologies", """, ranked AS (SELECT run_id, row_number() OVER (ORDER BY start_time_ms DESC) AS n FROM runs), found AS (SELECT n, final_domain, technology_name, technology_category FROM url_technologies t JOIN url_status u ON t.url_status_id = u.id JOIN ranked USING (run_id))
SELECT DISTINCT technology_name AS new_technology, technology_category, final_domain FROM found a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM found b WHERE b.n = 2 AND b.technology_name = a.technology_name AND b.final_domain = a.final_domain)""")
def _(t):
    # the two run ids first, so that their filter reaches the scans; runs are a row each
    ids = [r["run_id"] for r in t.runs.orderBy(F.desc("start_time_ms"), F.desc("run_id")).limit(2).collect()]
    found = lambda run_id: t.of_runs(run_id).technologies_with("final_domain").select("final_domain", "technology_name", "technology_category")
    new = found(ids[0]) if ids else t.technologies_with("final_domain").where("false")
    if len(ids) > 1:
        new = new.join(found(ids[1]), ["technology_name", "final_domain"], "left_anti")
    return new.select(F.col("technology_name").alias("new_technology"), "technology_category", "final_domain").distinct().orderBy("final_domain", "technology_category")


@query("q25_errors_by_type", "SELECT error_type, count(*) AS error_count, count(DISTINCT initial_domain) AS affected_domains FROM url_failures GROUP BY 1")
def _(t):
    return t.url_failures.groupBy("error_type").agg(F.count("*").alias("error_count"), F.count_distinct("initial_domain").alias("affected_domains")).orderBy(F.desc("error_count"), "error_type")


@query("q26_most_failures", "SELECT initial_domain, count(*) AS failure_count, string_agg(DISTINCT error_type, ',' ORDER BY error_type) AS error_types FROM url_failures GROUP BY 1 ORDER BY failure_count DESC, initial_domain LIMIT 20")
def _(t):
    return t.url_failures.groupBy("initial_domain").agg(F.count("*").alias("failure_count"), listed("error_type").alias("error_types")).orderBy(F.desc("failure_count"), "initial_domain").limit(20)


@query("q27_slowest", f"SELECT initial_domain, final_domain, response_time_seconds, {TIME.format('observed_at_ms')} AS scanned_at FROM url_status ORDER BY response_time_seconds DESC, id LIMIT 20")
def _(t):
    return t.url_status.orderBy(F.desc("response_time_seconds"), "id").limit(20).select("initial_domain", "final_domain", "response_time_seconds", S.epoch_text("observed_at_ms").alias("scanned_at"))


@query("q28_response_times", "SELECT final_domain, round(avg(response_time_seconds), 3) AS avg_response_time, round(min(response_time_seconds), 3) AS min_response_time, round(max(response_time_seconds), 3) AS max_response_time, count(*) AS request_count FROM url_status GROUP BY 1")
def _(t):
    r = "response_time_seconds"
    return t.url_status.groupBy("final_domain").agg(F.round(F.avg(r), 3).alias("avg_response_time"), F.round(F.min(r), 3).alias("min_response_time"), F.round(F.max(r), 3).alias("max_response_time"), F.count("*").alias("request_count")).orderBy(F.desc("avg_response_time"), "final_domain")


@query("q29_no_tls", "SELECT initial_domain, final_domain, http_status FROM url_status WHERE tls_version IS NULL")
def _(t):
    return t.url_status.where(F.col("tls_version").isNull()).select("initial_domain", "final_domain", "http_status").orderBy("final_domain")


@query("q30a_no_https", "SELECT initial_domain, final_domain, final_url FROM url_status WHERE final_url NOT ILIKE 'https://%'")
def _(t):
    return t.url_status.where(S.not_like("final_url", "https://%")).select("initial_domain", "final_domain", "final_url").orderBy("final_domain")


@query("q30b_weak_tls", "SELECT initial_domain, final_domain, tls_version FROM url_status WHERE tls_version NOT IN ('TLS 1.2', 'TLS 1.3', 'TLSv1.2', 'TLSv1.3')")
def _(t):
    return t.url_status.where(F.col("tls_version").isNotNull() & ~F.col("tls_version").isin("TLS 1.2", "TLS 1.3", "TLSv1.2", "TLSv1.3")).select("initial_domain", "final_domain", "tls_version").orderBy("final_domain")


@query("q30c_bad_certificates", f"SELECT initial_domain, final_domain, cert_is_self_signed, cert_is_mismatched, ssl_cert_valid_to_ms FROM url_status WHERE cert_is_self_signed OR cert_is_mismatched OR ssl_cert_valid_to_ms < {AS_OF_MS}")
def _(t):
    return t.url_status.where(F.col("cert_is_self_signed") | F.col("cert_is_mismatched") | (F.col("ssl_cert_valid_to_ms") < AS_OF_MS)).select("initial_domain", "final_domain", "cert_is_self_signed", "cert_is_mismatched", "ssl_cert_valid_to_ms").orderBy("final_domain")


@query("q31_secrets_by_severity", "SELECT initial_domain, secret_type, severity, location, matched_value, context FROM url_exposed_secrets s JOIN url_status u ON s.url_status_id = u.id")
def _(t):
    return of_status(t, t.url_exposed_secrets.drop("id")).orderBy(S.severity_rank("severity"), "initial_domain").select("initial_domain", "secret_type", "severity", "location", "matched_value", "context")


@query("q32_secret_counts", "SELECT secret_type, severity, count(*) AS count, count(DISTINCT url_status_id) AS affected_domains FROM url_exposed_secrets GROUP BY 1, 2")
def _(t):
    return t.url_exposed_secrets.groupBy("secret_type", "severity").agg(F.count("*").alias("count"), F.count_distinct("url_status_id").alias("affected_domains")).orderBy(S.severity_rank("severity"), F.desc("count"), "secret_type")


for number, kind in ((33, "email"), (34, "phone")):

    @query(f"q{number}_{kind}_contacts", f"SELECT initial_domain, contact_value AS {kind}, raw_href FROM url_contact_links c JOIN url_status u ON c.url_status_id = u.id WHERE contact_type = '{kind}'")
    def _(t, kind=kind):
        return of_status(t, t.url_contact_links.where(F.col("contact_type") == kind)).select("initial_domain", F.col("contact_value").alias(kind), "raw_href").orderBy("initial_domain")


@query("q35_domain_summary", """, best AS (SELECT final_domain, arg_min(http_status, id) AS http_status, round(arg_min(response_time_seconds, id), 3) AS response_time, count(*) AS url_count FROM url_status GROUP BY 1)
SELECT b.final_domain, url_count, http_status, response_time, count(DISTINCT technology_name) AS technology_count, string_agg(DISTINCT technology_name, ',' ORDER BY technology_name) AS technologies
FROM best b LEFT JOIN (SELECT final_domain, technology_name FROM url_status u JOIN url_technologies t ON u.id = t.url_status_id) x ON b.final_domain = x.final_domain GROUP BY ALL""")
def _(t):
    # one aggregate of each side, joined by domain: the join's fan-out is never aggregated
    best = t.url_status.groupBy("final_domain").agg(F.count("*").alias("url_count"), F.min_by("http_status", "id").alias("http_status"), F.round(F.min_by("response_time_seconds", "id"), 3).alias("response_time"))
    techs = t.technologies_with("final_domain").groupBy("final_domain").agg(F.sort_array(F.collect_set("technology_name")).alias("names"))
    return best.join(techs, "final_domain", "left").select("final_domain", "url_count", "http_status", "response_time", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("technology_count"), F.array_join("names", ",").alias("technologies")).orderBy(F.desc("url_count"), "final_domain")


@query("q36_many_redirects", "SELECT any_value(final_domain) AS final_domain, any_value(initial_domain) AS initial_domain, count(*) AS redirect_count, string_agg(redirect_url, ' -> ' ORDER BY sequence_order) AS redirect_chain FROM url_status u JOIN url_redirect_chain r ON u.id = r.url_status_id GROUP BY u.id HAVING count(*) > 3")
def _(t):
    hops = F.transform(F.sort_array(F.collect_list(F.struct("sequence_order", "redirect_url"))), lambda s: s["redirect_url"])
    # the observation's columns come along with its lines, so observations are ranked and joined once
    key = ["url_status_id", "final_domain", "initial_domain"]
    chains = t.redirect_chain_with(*key[1:]).groupBy(*key).agg(F.count("*").alias("redirect_count"), F.array_join(hops, " -> ").alias("redirect_chain")).where("redirect_count > 3")
    return chains.select("final_domain", "initial_domain", "redirect_count", "redirect_chain").orderBy(F.desc("redirect_count"), "initial_domain")


@query("q37_shared_certificates", "SELECT san_value, count(DISTINCT final_domain) AS domain_count, string_agg(DISTINCT final_domain, ',' ORDER BY final_domain) AS domains FROM url_certificate_sans s JOIN url_status u ON s.url_status_id = u.id GROUP BY 1 HAVING count(DISTINCT final_domain) > 1")
def _(t):
    names = of_status(t, t.url_certificate_sans).select("san_value", "final_domain").distinct()
    return names.groupBy("san_value").agg(F.count("*").alias("domain_count"), listed("final_domain").alias("domains")).where("domain_count > 1").orderBy(F.desc("domain_count"), "san_value")


@query("q38_jwt_claims", f"SELECT final_domain, secret_type, algorithm, issuer, subject, {TIME.format('expiration_ms')} AS expires, {TIME.format('issued_at_ms')} AS issued_at FROM url_jwt_claims j JOIN url_exposed_secrets s ON s.id = j.exposed_secret_id JOIN url_status u ON u.id = s.url_status_id")
def _(t):
    claims = t.url_jwt_claims.join(t.url_exposed_secrets.withColumnRenamed("id", "exposed_secret_id"), "exposed_secret_id")
    return of_status(t, claims).orderBy(F.desc("expiration_ms"), "final_domain").select("final_domain", "secret_type", "algorithm", "issuer", "subject", S.epoch_text("expiration_ms").alias("expires"), S.epoch_text("issued_at_ms").alias("issued_at"))


@query("q39_jwt_counts", "SELECT algorithm, issuer, count(*) AS token_count FROM url_jwt_claims GROUP BY 1, 2")
def _(t):
    return t.url_jwt_claims.groupBy("algorithm", "issuer").agg(F.count("*").alias("token_count")).orderBy(F.desc("token_count"), "algorithm", "issuer")


@query("missing_hsts", "SELECT final_domain FROM url_status u WHERE NOT EXISTS (SELECT 1 FROM url_security_headers h WHERE h.url_status_id = u.id AND header_name = 'Strict-Transport-Security')")
def _(t):
    have = t.url_security_headers.where("header_name = 'Strict-Transport-Security'").select(F.col("url_status_id").alias("id"))
    return t.url_status.join(have, "id", "left_anti").select("final_domain")


@query("whois_of_run", "SELECT final_domain, registrar, registrant_country, registrant_org, whois_statuses FROM url_status u JOIN url_whois w ON w.url_status_id = u.id WHERE run_id = 'run_1997'")
def _(t):
    return of_status(t, t.url_whois).where("run_id = 'run_1997'").select("final_domain", "registrar", "registrant_country", "registrant_org", "whois_statuses")


@query("upsert_latest_wins", "SELECT id, run_id, initial_domain, observed_at_ms, http_status FROM url_status")
def _(t):
    return t.url_status.select("id", "run_id", "initial_domain", "observed_at_ms", "http_status")
