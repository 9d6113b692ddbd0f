"""The star schema of web observations, derived from the driver's relational tables.

`Star(spark, sf_dir)` has each table as a DataFrame; CTES has the same tables as DuckDB SQL, for the oracle.
Timestamps become epoch milliseconds by calendar arithmetic, so no session time zone matters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The instant that stands for "now" in queries over these tables.
AS_OF_MS = 946_684_800_000


def epoch_ms(ts: str) -> Column:
    t = F.col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * DAY_MS + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.second(t) * 1000


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        return self.observed(self.raw("orders"))

    def observed(self, orders: DataFrame, *more: str) -> DataFrame:
        """Observations as orders give them, row by row, with more of the rows' columns."""
        c, o, status, prio = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
        final = say("f", c % 300, ".example")
        low = prio.startswith("5")
        return orders.select(
            o.alias("id"), c.alias("custkey"), say("c", c, ".example").alias("initial_domain"), final.alias("final_domain"), say("run_", F.year("o_orderdate")).alias("run_id"),
            F.when(status == "O", 200).when(status == "P", 404).otherwise(403).alias("http_status"),
            F.when(status == "O", "OK").when(status == "P", "Not Found").otherwise("Forbidden").alias("http_status_text"),
            (F.col("o_totalprice") / 100000.0).alias("response_time_seconds"), epoch_ms("o_orderdate").alias("observed_at_ms"),
            F.when(low, None).when(prio.startswith("4"), "TLSv1.1").otherwise("TLSv1.3").alias("tls_version"),
            F.concat(F.when(low, "http://").otherwise("https://"), final, F.lit("/")).alias("final_url"),
            F.when(c % 4 == 0, "").otherwise(say("Title ", c % 50)).alias("title"),
            F.when(c % 3 == 0, say("v=spf1 include:_spf", c % 9, ".example -all")).alias("spf_record"),
            F.when(c % 5 == 0, "v=DMARC1; p=reject").alias("dmarc_record"),
            F.when(~low, say("Issuer ", c % 7)).alias("ssl_cert_issuer"),
            F.when(~low, epoch_ms("o_orderdate") + (o % 900) * DAY_MS).alias("ssl_cert_valid_to_ms"),
            F.when(o % 6 != 0, say("body", o % 700)).alias("body_sha256"), F.when(~low, say("fp", c % 200)).alias("cert_fingerprint_sha256"),
            F.when(o % 4 == 0, None).when(o % 4 == 1, "HTTP/1.1").otherwise("HTTP/2").alias("http_version"),
            F.when(~low, o % 37 == 0).alias("cert_is_self_signed"), F.when(~low, o % 41 == 0).alias("cert_is_mismatched"), *more,
        )

    @cached_property
    def url_status(self) -> DataFrame:
        from webstrata.operators.upsert import latest

        return latest(self.observations, ["run_id", "initial_domain"], ["observed_at_ms", "id"])

    @cached_property
    def runs(self) -> DataFrame:
        ok = F.col("http_status") < 400
        per = self.url_status.groupBy("run_id").agg(F.min("observed_at_ms").alias("start_time_ms"), F.max("observed_at_ms").alias("last"), F.count("*").alias("total_urls"), F.count_if(ok).alias("successful_urls"), F.count_if(~ok).alias("failed_urls"))
        newest = F.max("run_id").over(Window.partitionBy(F.lit(1)))  # a row a run
        return per.select("run_id", F.lit("1.0").alias("version"), "start_time_ms", F.when(F.col("run_id") != newest, F.col("last")).alias("end_time_ms"), ((F.col("last") - F.col("start_time_ms")) / 1000.0).alias("elapsed_seconds"), "total_urls", "successful_urls", "failed_urls", F.lit(0).cast("long").alias("skipped_urls"))

    def of_runs(self, *run_ids: str) -> Star:
        """The same tables of some runs only; the filter reaches the scan."""
        own = Star(self.spark, self.sf_dir)
        own.observations = self.observations.where(F.col("run_id").isin(*run_ids))
        return own

    def lines_with(self, *columns: str) -> DataFrame:
        """Line items of observations that won, with some of the observation's columns."""
        return self.raw("lineitem").join(self.url_status.select(F.col("id").alias("l_orderkey"), *columns), "l_orderkey")

    @cached_property
    def lines(self) -> DataFrame:
        return self.lines_with()

    def technologies_with(self, *columns: str) -> DataFrame:
        """url_technologies with some of the observation's columns, from one join with the observations."""
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
        t = self.lines_with(*columns).join(p, "l_partkey").select(F.col("l_orderkey").alias("url_status_id"), F.col("p_brand").alias("technology_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).alias("technology_version"), F.col("p_type").alias("technology_category"), (F.col("l_returnflag") == "R").alias("is_implied"), *columns)
        return t.groupBy("url_status_id", "technology_name", "technology_version", *columns).agg(F.min("technology_category").alias("technology_category"), F.bool_and("is_implied").alias("is_implied"))

    @cached_property
    def url_technologies(self) -> DataFrame:
        return self.technologies_with()

    @cached_property
    def url_redirect_chain(self) -> DataFrame:
        return self.redirect_chain_with()

    def redirect_chain_with(self, *columns: str) -> DataFrame:
        """url_redirect_chain with some of the observation's columns, from one join with the observations."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        return self.lines_with(*columns).select(F.col("l_orderkey").alias("url_status_id"), *columns, F.row_number().over(order).alias("sequence_order"), say("https://s", F.col("l_suppkey"), ".example/").alias("redirect_url"), F.when(F.col("l_linestatus") == "O", 301).otherwise(302).alias("http_status"))

    @cached_property
    def url_geoip(self) -> DataFrame:
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        places = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return self.url_status.join(places, F.col("custkey") == F.col("c_custkey")).select(F.col("id").alias("url_status_id"), F.substring("n_name", 1, 9).alias("country_code"), F.col("n_name").alias("country_name"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("city"))

    @cached_property
    def url_whois(self) -> DataFrame:
        c = self.raw("customer")
        return self.url_status.join(c, F.col("custkey") == F.col("c_custkey")).where("custkey % 2 = 0").select(F.col("id").alias("url_status_id"), say("Registrar ", F.col("c_nationkey") % 5).alias("registrar"), say("N", F.col("c_nationkey")).alias("registrant_country"), F.col("c_name").alias("registrant_org"), F.lit('["ok","active"]').alias("whois_statuses"))

    def of_lines(self, **columns: Column) -> DataFrame:
        return self.lines.select(F.col("l_orderkey").alias("url_status_id"), *[v.alias(k) for k, v in columns.items()]).distinct()

    @cached_property
    def url_nameservers(self) -> DataFrame:
        s = self.raw("supplier")
        return self.lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("url_status_id"), say("ns", F.col("s_nationkey"), ".example").alias("nameserver")).distinct()

    @cached_property
    def url_certificate_sans(self) -> DataFrame:
        s = self.raw("supplier")
        return self.lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("url_status_id"), F.col("s_name").alias("san_value")).distinct()

    @cached_property
    def url_mx_records(self) -> DataFrame:
        return self.of_lines(priority=F.col("l_linenumber") * 10, mail_exchange=say("mx", F.col("l_suppkey") % 20, ".example"))

    @cached_property
    def url_txt_records(self) -> DataFrame:
        from webstrata.functions.scalar import txt_kind

        each = F.explode(F.array("spf_record", "dmarc_record", say("site-verification=", F.col("custkey") % 11)))
        return self.url_status.select(F.col("id").alias("url_status_id"), each.alias("record_value")).where("record_value IS NOT NULL").select("url_status_id", txt_kind("record_value").alias("record_type"), "record_value")

    @cached_property
    def url_cname_records(self) -> DataFrame:
        return self.of_lines(cname_target=say("cdn", F.col("l_suppkey") % 13, ".example"))

    @cached_property
    def url_ipv6_addresses(self) -> DataFrame:
        return self.of_lines(ipv6_address=say("2001:db8::", F.col("l_suppkey") % 97))

    @cached_property
    def url_caa_records(self) -> DataFrame:
        return self.of_lines(flag=F.col("l_linenumber") % 2, tag=F.when(F.col("l_linenumber") % 3 == 0, "iodef").otherwise("issue"), value=say("ca", F.col("l_suppkey") % 5, ".example")).groupBy("url_status_id", "tag", "value").agg(F.max("flag").alias("flag"))

    @cached_property
    def url_security_headers(self) -> DataFrame:
        name = F.when(F.col("l_linenumber") % 3 == 0, "Strict-Transport-Security").when(F.col("l_linenumber") % 3 == 1, "Content-Security-Policy").otherwise("X-Frame-Options")
        return self.lines.groupBy(F.col("l_orderkey").alias("url_status_id"), name.alias("header_name")).agg(say("v", F.max("l_suppkey")).alias("header_value"))

    @cached_property
    def url_exposed_secrets(self) -> DataFrame:
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        tax = F.max("l_tax")
        severity = F.when(tax >= 0.07, "critical").when(tax >= 0.05, "high").when(tax >= 0.02, "medium").otherwise("low")
        found = self.lines.where("l_discount >= 0.08").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("url_status_id"), F.col("l_partkey"), F.col("p_type").alias("secret_type"))
        return found.agg(severity.alias("severity")).select((F.col("url_status_id") * 1_000_000 + F.col("l_partkey")).alias("id"), "url_status_id", "secret_type", F.col("l_partkey").cast("string").alias("matched_value"), "severity", F.when(F.col("l_partkey") % 2 == 0, "inline_script").otherwise("html_body").alias("location"), say("near ", F.col("l_partkey")).alias("context"), "l_partkey")

    @cached_property
    def url_jwt_claims(self) -> DataFrame:
        k = F.col("l_partkey")
        return self.url_exposed_secrets.where(k % 5 == 0).select(F.col("id").alias("exposed_secret_id"), F.when(k % 2 == 0, "HS256").otherwise("RS256").alias("algorithm"), F.when(k % 3 != 0, say("iss", k % 4)).alias("issuer"), say("sub", k).alias("subject"), (k * DAY_MS).alias("expiration_ms"), F.when(k % 7 != 0, k * 3_600_000).alias("issued_at_ms"))

    @cached_property
    def url_contact_links(self) -> DataFrame:
        email, phone = F.struct(F.lit("email").alias("contact_type"), say("u", F.col("custkey"), "@example.org").alias("contact_value"), say("mailto:u", F.col("custkey"), "@example.org").alias("raw_href")), F.struct(F.lit("phone").alias("contact_type"), say("+1555", F.col("custkey")).alias("contact_value"), say("tel:+1555", F.col("custkey")).alias("raw_href"))
        return self.url_status.where("custkey % 3 <> 1").select(F.col("id").alias("url_status_id"), F.explode(F.array(email, phone)).alias("x")).select("url_status_id", "x.*")

    @cached_property
    def url_failures(self) -> DataFrame:
        kind = F.when(F.col("value") < 30, "DNS error").when(F.col("value") < 90, "Process URL timeout").when(F.col("value") < 150, "TLS error").otherwise("HTTP request error")
        return self.raw("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), say("u", F.col("user_id"), ".example").alias("initial_domain"), kind.alias("error_type"), say("failed ", F.col("event_id") % 10).alias("error_message"), epoch_ms("ts").alias("observed_at_ms"), F.col("value").alias("elapsed_time_seconds"))


#: The same tables for DuckDB, in order of dependence.
CTES = {
    "observations": """SELECT o_orderkey AS id, o_custkey AS custkey, concat('c', o_custkey, '.example') AS initial_domain, concat('f', o_custkey % 300, '.example') AS final_domain, concat('run_', year(o_orderdate)) AS run_id,
 CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'P' THEN 404 ELSE 403 END AS http_status, CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'P' THEN 'Not Found' ELSE 'Forbidden' END AS http_status_text,
 o_totalprice / 100000.0 AS response_time_seconds, epoch_ms(o_orderdate) AS observed_at_ms, CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderpriority LIKE '4%' THEN 'TLSv1.1' ELSE 'TLSv1.3' END AS tls_version,
 concat(CASE WHEN o_orderpriority LIKE '5%' THEN 'http://' ELSE 'https://' END, 'f', o_custkey % 300, '.example/') AS final_url, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('Title ', o_custkey % 50) END AS title,
 CASE WHEN o_custkey % 3 = 0 THEN concat('v=spf1 include:_spf', o_custkey % 9, '.example -all') END AS spf_record, CASE WHEN o_custkey % 5 = 0 THEN 'v=DMARC1; p=reject' END AS dmarc_record,
 CASE WHEN o_orderpriority NOT LIKE '5%' THEN concat('Issuer ', o_custkey % 7) END AS ssl_cert_issuer, CASE WHEN o_orderpriority NOT LIKE '5%' THEN epoch_ms(o_orderdate) + (o_orderkey % 900) * 86400000 END AS ssl_cert_valid_to_ms,
 CASE WHEN o_orderkey % 6 <> 0 THEN concat('body', o_orderkey % 700) END AS body_sha256, CASE WHEN o_orderpriority NOT LIKE '5%' THEN concat('fp', o_custkey % 200) END AS cert_fingerprint_sha256,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP/1.1' ELSE 'HTTP/2' END AS http_version, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderkey % 37 = 0 END AS cert_is_self_signed, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderkey % 41 = 0 END AS cert_is_mismatched FROM orders""",
    "url_status": "SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY run_id, initial_domain ORDER BY observed_at_ms DESC, id DESC) = 1",
    "runs": "SELECT run_id, '1.0' AS version, min(observed_at_ms) AS start_time_ms, CASE WHEN run_id <> (SELECT max(run_id) FROM url_status) THEN max(observed_at_ms) END AS end_time_ms, (max(observed_at_ms) - min(observed_at_ms)) / 1000.0 AS elapsed_seconds, count(*) AS total_urls, count(*) FILTER (http_status < 400) AS successful_urls, count(*) FILTER (http_status >= 400) AS failed_urls, 0::BIGINT AS skipped_urls FROM url_status GROUP BY run_id",
    "lines": "SELECT l.* FROM lineitem l JOIN url_status u ON l.l_orderkey = u.id",
    "url_technologies": "SELECT l_orderkey AS url_status_id, p_brand AS technology_name, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS technology_version, min(p_type) AS technology_category, bool_and(l_returnflag = 'R') AS is_implied FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "url_redirect_chain": "SELECT l_orderkey AS url_status_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INTEGER AS sequence_order, concat('https://s', l_suppkey, '.example/') AS redirect_url, CASE l_linestatus WHEN 'O' THEN 301 ELSE 302 END AS http_status FROM lines",
    "url_geoip": "SELECT id AS url_status_id, substr(n_name, 1, 9) AS country_code, n_name AS country_name, r_name AS region, c_mktsegment AS city FROM url_status JOIN customer ON custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "url_whois": """SELECT id AS url_status_id, concat('Registrar ', c_nationkey % 5) AS registrar, concat('N', c_nationkey) AS registrant_country, c_name AS registrant_org, '["ok","active"]' AS whois_statuses FROM url_status JOIN customer ON custkey = c_custkey WHERE custkey % 2 = 0""",
    "url_nameservers": "SELECT DISTINCT l_orderkey AS url_status_id, concat('ns', s_nationkey, '.example') AS nameserver FROM lines JOIN supplier ON l_suppkey = s_suppkey",
    "url_certificate_sans": "SELECT DISTINCT l_orderkey AS url_status_id, s_name AS san_value FROM lines JOIN supplier ON l_suppkey = s_suppkey",
    "url_mx_records": "SELECT DISTINCT l_orderkey AS url_status_id, l_linenumber * 10 AS priority, concat('mx', l_suppkey % 20, '.example') AS mail_exchange FROM lines",
    "url_txt_records": "SELECT id AS url_status_id, CASE WHEN v LIKE 'v=spf1%' THEN 'SPF' WHEN v LIKE 'v=DMARC1%' THEN 'DMARC' ELSE 'VERIFICATION' END AS record_type, v AS record_value FROM (SELECT id, unnest([spf_record, dmarc_record, concat('site-verification=', custkey % 11)]) AS v FROM url_status) WHERE v IS NOT NULL",
    "url_cname_records": "SELECT DISTINCT l_orderkey AS url_status_id, concat('cdn', l_suppkey % 13, '.example') AS cname_target FROM lines",
    "url_ipv6_addresses": "SELECT DISTINCT l_orderkey AS url_status_id, concat('2001:db8::', l_suppkey % 97) AS ipv6_address FROM lines",
    "url_caa_records": "SELECT l_orderkey AS url_status_id, CASE WHEN l_linenumber % 3 = 0 THEN 'iodef' ELSE 'issue' END AS tag, concat('ca', l_suppkey % 5, '.example') AS value, max(l_linenumber % 2) AS flag FROM lines GROUP BY 1, 2, 3",
    "url_security_headers": "SELECT l_orderkey AS url_status_id, CASE l_linenumber % 3 WHEN 0 THEN 'Strict-Transport-Security' WHEN 1 THEN 'Content-Security-Policy' ELSE 'X-Frame-Options' END AS header_name, concat('v', max(l_suppkey)) AS header_value FROM lines GROUP BY 1, 2",
    "url_exposed_secrets": "SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey AS url_status_id, p_type AS secret_type, l_partkey::VARCHAR AS matched_value, CASE WHEN max(l_tax) >= 0.07 THEN 'critical' WHEN max(l_tax) >= 0.05 THEN 'high' WHEN max(l_tax) >= 0.02 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN l_partkey % 2 = 0 THEN 'inline_script' ELSE 'html_body' END AS location, concat('near ', l_partkey) AS context, l_partkey FROM lines JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.08 GROUP BY l_orderkey, l_partkey, p_type",
    "url_jwt_claims": "SELECT id AS exposed_secret_id, CASE WHEN l_partkey % 2 = 0 THEN 'HS256' ELSE 'RS256' END AS algorithm, CASE WHEN l_partkey % 3 <> 0 THEN concat('iss', l_partkey % 4) END AS issuer, concat('sub', l_partkey) AS subject, l_partkey * 86400000 AS expiration_ms, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey * 3600000 END AS issued_at_ms FROM url_exposed_secrets WHERE l_partkey % 5 = 0",
    "url_contact_links": "SELECT id AS url_status_id, 'email' AS contact_type, concat('u', custkey, '@example.org') AS contact_value, concat('mailto:u', custkey, '@example.org') AS raw_href FROM url_status WHERE custkey % 3 <> 1 UNION ALL SELECT id, 'phone', concat('+1555', custkey), concat('tel:+1555', custkey) FROM url_status WHERE custkey % 3 <> 1",
    "url_failures": "SELECT event_id AS id, concat('u', user_id, '.example') AS initial_domain, CASE WHEN value < 30 THEN 'DNS error' WHEN value < 90 THEN 'Process URL timeout' WHEN value < 150 THEN 'TLS error' ELSE 'HTTP request error' END AS error_type, concat('failed ', event_id % 10) AS error_message, epoch_ms(date_trunc('second', ts)) AS observed_at_ms, value AS elapsed_time_seconds FROM events WHERE event_type = 'error'",
}


def with_tables(body: str) -> str:
    """body over the star schema, as one DuckDB statement with just the tables that it needs."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and name in text:
                needed.add(name)
                todo.append(CTES[name])
    used = [f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed]
    own = body.startswith(", ")
    return f"WITH {', '.join(used)}{body}" if own and used else f"WITH {', '.join(used)} {body}" if used else body
