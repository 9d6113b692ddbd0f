"""The three exports over the star schema, whole: every column of the flat one, the JSON lines read back, and the nested rows.
Tables that the driver's data lack are built from keys, on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import export
from webstrata.plans import nested
from webstrata.plans.bridge import Star, say, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STORED = ["url_technologies", "url_redirect_chain", "url_geoip", "url_nameservers", "url_certificate_sans", "url_mx_records", "url_txt_records", "url_cname_records", "url_ipv6_addresses", "url_caa_records", "url_security_headers", "url_exposed_secrets", "url_jwt_claims", "url_contact_links"]


def more_facts() -> dict[str, Column]:
    i = F.col("id")
    return {
        "response_time_seconds": i % 1000 / 100.0 + 0.001, "initial_url": say("http://", F.col("initial_domain")), "ip_address": F.when(i % 2 == 0, "").otherwise(say("10.0.0.", i % 200)), "reverse_dns_name": F.when(i % 3 == 0, say("r", i, '"q",x')), "description": F.when(i % 4 == 0, say("d\n", i)),
        "meta_robots": F.when(i % 5 == 0, "noindex"), "content_length": i % 9999, "content_type": F.lit("text/html"), "canonical_url": F.when(i % 7 == 0, say("https://c/", i)), "body_truncated": F.when(i % 6 == 0, True), "ssl_cert_subject": say("CN=", F.col("final_domain")), "cipher_suite": F.lit("X"), "key_algorithm": F.when(i % 2 == 0, "RSA"),
    }


def tables(t: Star) -> dict[str, DataFrame]:
    i, s, n = F.col("id"), F.col("l_suppkey"), F.col("l_linenumber")
    facts = t.url_status.withColumns(more_facts())
    out = {n: getattr(t, n) for n in STORED} | {"url_status": facts}
    out["url_certificate_oids"] = t.of_lines(oid=say("1.3.", s % 11))
    out["url_analytics_ids"] = t.of_lines(provider=F.when(n % 2 == 0, "GA").otherwise("GTM"), tracking_id=say("T-", s % 30))
    out["url_social_media_links"] = t.of_lines(platform=F.when(n % 2 == 0, "GitHub").otherwise("Twitter"), profile_url=say("https://p/", s % 40), identifier=F.when(s % 40 % 3 > 0, say("u", s % 40)))
    out["url_structured_data"] = t.of_lines(data_type=F.when(n % 2 == 0, "open_graph").otherwise("json_ld"), property_name=F.when(n % 2 == 0, say("og", s % 5)).otherwise(""), property_value=say("v", s % 20))
    name = F.when(n % 3 == 0, "Server").when(n % 3 == 1, "X-Powered-By").otherwise("ETag")
    out["url_http_headers"] = t.lines.groupBy(F.col("l_orderkey").alias("url_status_id"), name.alias("header_name")).agg(say("h", F.max("l_suppkey")).alias("header_value"))
    out["url_partial_failures"] = t.of_lines(error_type=F.when(n % 2 == 0, "DNS").otherwise("WHOIS"), error_message=say("m", s % 6)).where("url_status_id % 3 = 0")
    one = t.url_status.where("id % 2 = 1")
    out["url_favicons"] = one.select(i.alias("url_status_id"), say("https://i/", i).alias("favicon_url"), (i % 77 - 30).cast("int").alias("hash"))
    out["url_whois"] = t.url_whois.withColumn("creation_date_ms", F.col("url_status_id") % 5000 * 86_400_000)
    return out


def whole(t: Star) -> DataFrame:
    """All observations' wide rows. A run's come from tables(t), where its filter reaches the scan."""
    return export.wide(nested.observations(t, more_facts()))


LISTS = """, facts AS (SELECT * REPLACE (id % 1000 / 100.0 + 0.001 AS response_time_seconds), concat('http://', initial_domain) AS initial_url, CASE WHEN id % 2 = 0 THEN '' ELSE concat('10.0.0.', id % 200) END AS ip_address, CASE WHEN id % 3 = 0 THEN concat('r', id, '"q",x') END AS reverse_dns_name, CASE WHEN id % 4 = 0 THEN concat('d', chr(10), id) END AS description,
 CASE WHEN id % 5 = 0 THEN 'noindex' END AS meta_robots, id % 9999 AS content_length, CASE WHEN id % 7 = 0 THEN concat('https://c/', id) END AS canonical_url, id % 6 = 0 AS body_truncated, concat('CN=', final_domain) AS ssl_cert_subject, CASE WHEN id % 2 = 0 THEN 'RSA' END AS key_algorithm FROM url_status),
chain AS (SELECT url_status_id AS id, count(*) AS n, arg_max(redirect_url, sequence_order) AS last, list({'redirect_url': redirect_url, 'sequence_order': sequence_order, 'http_status': http_status} ORDER BY sequence_order) AS l FROM url_redirect_chain GROUP BY 1),
tech AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(technology_name, ':', technology_version), ',' ORDER BY technology_name, technology_version NULLS FIRST, technology_category) AS s, string_agg(technology_category, ', ' ORDER BY technology_name, technology_version NULLS FIRST, technology_category) AS c, list({'name': technology_name, 'version': technology_version, 'category': technology_category, 'is_implied': is_implied} ORDER BY technology_name, technology_version NULLS FIRST, technology_category) AS l FROM url_technologies WHERE NOT is_implied GROUP BY 1),
san AS (SELECT url_status_id AS id, count(*) AS n, string_agg(san_value, ',' ORDER BY san_value) AS s, list(san_value ORDER BY san_value) AS l FROM url_certificate_sans GROUP BY 1),
oid AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey % 11) AS n, string_agg(DISTINCT concat('1.3.', l_suppkey % 11), ',' ORDER BY concat('1.3.', l_suppkey % 11)) AS s FROM lines GROUP BY 1),
ns AS (SELECT url_status_id AS id, count(*) AS n, string_agg(nameserver, ',' ORDER BY nameserver) AS s, list(nameserver ORDER BY nameserver) AS l FROM url_nameservers GROUP BY 1),
txt AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(record_type, '|', record_value), ',' ORDER BY record_type, record_value) AS s FROM url_txt_records GROUP BY 1),
mx AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(priority, ':', mail_exchange), ',' ORDER BY priority, mail_exchange) AS s, list({'priority': priority, 'mail_exchange': mail_exchange} ORDER BY priority, mail_exchange) AS l FROM url_mx_records GROUP BY 1),
cname AS (SELECT url_status_id AS id, count(*) AS n, string_agg(cname_target, ', ' ORDER BY cname_target) AS s FROM url_cname_records GROUP BY 1),
six AS (SELECT url_status_id AS id, count(*) AS n, string_agg(ipv6_address, ', ' ORDER BY ipv6_address) AS s FROM url_ipv6_addresses GROUP BY 1),
caa AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(flag, ' ', tag, ' ', value), ', ' ORDER BY tag, value) AS s FROM url_caa_records GROUP BY 1),
ana AS (SELECT id, count(*) AS n, string_agg(concat(p, ':', x), ',' ORDER BY p, x) AS s FROM (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'GA' ELSE 'GTM' END AS p, concat('T-', l_suppkey % 30) AS x FROM lines) GROUP BY 1),
soc AS (SELECT id, count(*) AS n, string_agg(concat(p, ':https://p/', k), ',' ORDER BY p, concat('https://p/', k)) AS s, string_agg(CASE WHEN k % 3 > 0 THEN concat(p, ':u', k) END, ',' ORDER BY p, concat('https://p/', k)) AS i FROM (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'GitHub' ELSE 'Twitter' END AS p, l_suppkey % 40 AS k FROM lines) GROUP BY 1),
sd AS (SELECT id, count(*) AS n, string_agg(DISTINCT d, ',' ORDER BY d) AS t, string_agg(concat(d, '|', p, '|', v), ',' ORDER BY d, p, v) AS s FROM (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'open_graph' ELSE 'json_ld' END AS d, CASE WHEN l_linenumber % 2 = 0 THEN concat('og', l_suppkey % 5) ELSE '' END AS p, concat('v', l_suppkey % 20) AS v FROM lines) GROUP BY 1),
http AS (SELECT id, count(*) AS n, string_agg(concat(h, ':', v), ';' ORDER BY h) FILTER (h <> 'ETag') AS s FROM (SELECT l_orderkey AS id, ['Server', 'X-Powered-By', 'ETag'][l_linenumber % 3 + 1] AS h, concat('h', max(l_suppkey)) AS v FROM lines GROUP BY 1, 2) GROUP BY 1),
sec AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(header_name, ':', header_value), ';' ORDER BY header_name) AS s FROM url_security_headers GROUP BY 1),
fail AS (SELECT id, count(*) AS n, string_agg(concat(e, ':', m), ',' ORDER BY e, m) AS s FROM (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'DNS' ELSE 'WHOIS' END AS e, concat('m', l_suppkey % 6) AS m FROM lines WHERE l_orderkey % 3 = 0) GROUP BY 1),
con AS (SELECT url_status_id AS id, count(*) AS n, string_agg(concat(contact_type, ':', contact_value), ',' ORDER BY contact_type, contact_value) AS s FROM url_contact_links GROUP BY 1),
sct AS (SELECT s.url_status_id AS id, count(*) AS n, string_agg(concat('[', severity, '] ', secret_type, '|', location, '|', matched_value, '|alg=' || algorithm, '|iss=' || issuer), '; ' ORDER BY severity, secret_type, matched_value) AS s, list({'type': secret_type, 'value': matched_value, 'claims': algorithm IS NOT NULL OR issuer IS NOT NULL} ORDER BY severity, secret_type, matched_value) AS l FROM url_exposed_secrets s LEFT JOIN url_jwt_claims j ON j.exposed_secret_id = s.id GROUP BY 1),
rows AS (SELECT f.*, concat('https://', final_domain) AS url, chain.n AS chain_n, chain.last, chain.l AS chain_l, tech.n AS tech_n, tech.s AS tech_s, tech.c AS tech_c, tech.l AS tech_l, san.n AS san_n, san.s AS san_s, san.l AS san_l, oid.n AS oid_n, oid.s AS oid_s, ns.n AS ns_n, ns.s AS ns_s, ns.l AS ns_l, txt.n AS txt_n, txt.s AS txt_s, mx.n AS mx_n, mx.s AS mx_s, mx.l AS mx_l, cname.n AS cname_n, cname.s AS cname_s, six.n AS six_n, six.s AS six_s, caa.n AS caa_n, caa.s AS caa_s,
 ana.n AS ana_n, ana.s AS ana_s, soc.n AS soc_n, soc.s AS soc_s, soc.i AS soc_i, sd.n AS sd_n, sd.t AS sd_t, sd.s AS sd_s, http.n AS http_n, http.s AS http_s, sec.n AS sec_n, sec.s AS sec_s, fail.n AS fail_n, fail.s AS fail_s, con.n AS con_n, con.s AS con_s, sct.n AS sct_n, sct.s AS sct_s, sct.l AS sct_l, g.country_code, g.country_name, g.region, g.city, w.registrar, w.registrant_country, w.url_status_id % 5000 * 86400000 AS creation_date_ms
 FROM facts f LEFT JOIN chain USING (id) LEFT JOIN tech USING (id) LEFT JOIN san USING (id) LEFT JOIN oid USING (id) LEFT JOIN ns USING (id) LEFT JOIN txt USING (id) LEFT JOIN mx USING (id) LEFT JOIN cname USING (id) LEFT JOIN six USING (id) LEFT JOIN caa USING (id) LEFT JOIN ana USING (id) LEFT JOIN soc USING (id) LEFT JOIN sd USING (id) LEFT JOIN http USING (id) LEFT JOIN sec USING (id) LEFT JOIN fail USING (id) LEFT JOIN con USING (id) LEFT JOIN sct USING (id) LEFT JOIN url_geoip g ON g.url_status_id = f.id LEFT JOIN url_whois w ON w.url_status_id = f.id)"""
DAY = "coalesce(strftime(make_timestamp({0} * 1000), '%Y-%m-%d'), '')"
#: The flat export's columns in SQL, with what is not simply a fact's text.
FLAT = {
    "url": "url", "initial_domain": "initial_domain", "final_domain": "final_domain", "initial_url": "", "final_url": "", "ip_address": "", "reverse_dns": "reverse_dns_name", "status": "http_status", "status_description": "http_status_text", "response_time_ms": "printf('%.2f', response_time_seconds)", "title": "", "description": "", "meta_robots": "", "body_sha256": "", "content_length": "",
    "http_version": "", "content_type": "'text/html'", "canonical_url": "", "body_truncated": "", "redirect_count": "coalesce(chain_n, 0)", "final_redirect_url": "last", "technologies": "tech_s", "technology_categories": "tech_c", "technology_count": "coalesce(tech_n, 0)", "tls_version": "", "ssl_cert_subject": "", "ssl_cert_issuer": "", "ssl_cert_valid_to": DAY.format("ssl_cert_valid_to_ms"),
    "cipher_suite": "'X'", "key_algorithm": "", "cert_fingerprint_sha256": "", "certificate_sans": "san_s", "certificate_san_count": "coalesce(san_n, 0)", "oids": "oid_s", "oid_count": "coalesce(oid_n, 0)", "nameserver_count": "coalesce(ns_n, 0)", "txt_record_count": "coalesce(txt_n, 0)", "mx_record_count": "coalesce(mx_n, 0)", "cname_records": "cname_s", "cname_count": "coalesce(cname_n, 0)",
    "ipv6_addresses": "six_s", "ipv6_count": "coalesce(six_n, 0)", "caa_records": "caa_s", "caa_count": "coalesce(caa_n, 0)", "spf_record": "", "dmarc_record": "", "analytics_ids": "ana_s", "analytics_count": "coalesce(ana_n, 0)", "social_media_links": "soc_s", "social_media_count": "coalesce(soc_n, 0)", "structured_data_types": "sd_t", "structured_data_count": "coalesce(sd_n, 0)",
    "http_headers": "http_s", "http_header_count": "coalesce(http_n, 0)", "security_headers": "sec_s", "security_header_count": "coalesce(sec_n, 0)", "geoip_country_code": "country_code", "geoip_country_name": "country_name", "geoip_region": "region", "geoip_city": "city", "geoip_latitude": "''", "geoip_longitude": "''", "geoip_asn": "''", "geoip_asn_org": "''",
    "whois_registrar": "registrar", "whois_creation_date": DAY.format("creation_date_ms"), "whois_expiration_date": "''", "whois_registrant_country": "registrant_country", "favicon_hash": "CASE WHEN id % 2 = 1 THEN id % 77 - 30 END", "favicon_url": "CASE WHEN id % 2 = 1 THEN concat('https://i/', id) END", "timestamp": "observed_at_ms", "run_id": "run_id", "nameservers": "ns_s", "txt_records": "txt_s", "mx_records": "mx_s",
    "structured_data_entries": "sd_s", "social_media_identifiers": "soc_i", "partial_failure_count": "coalesce(fail_n, 0)", "partial_failures": "fail_s", "contact_links": "con_s", "contact_link_count": "coalesce(con_n, 0)", "exposed_secrets": "sct_s", "exposed_secret_count": "coalesce(sct_n, 0)",
}


def query(name: str, sql: str):
    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(Star(spark, sf_dir))
        SQL[name] = with_tables(f"{LISTS} {sql}")
        return plan

    return add


@query("export_csv", "SELECT " + ", ".join(f'coalesce(({v or k})::VARCHAR, \'\') AS "{k}"' for k, v in FLAT.items()) + " FROM rows")
def _(t):
    return export.flat(whole(t))


@query("export_csv_of_run", "SELECT initial_domain, coalesce(tech_s, '') AS technologies, coalesce(sct_s, '') AS exposed_secrets FROM rows WHERE run_id = 'run_1997' AND http_status = 403")
def _(t):
    return export.flat(export.wide(tables(t), run_id="run_1997", status=403)).select("initial_domain", "technologies", "exposed_secrets")


JSON = "coalesce(to_json({0})::VARCHAR, '[]')"


#: Places of the JSON lines, and what SQL says of each as text.
PLACES = {
    **{n: n for n in ("url", "initial_domain", "final_domain", "initial_url", "final_url", "ip_address", "title", "description", "meta_robots", "body_sha256", "http_version", "canonical_url", "spf_record", "dmarc_record", "run_id")}, "reverse_dns": "reverse_dns_name", "status": "http_status::VARCHAR", "status_description": "http_status_text",
    "content_length": "content_length::VARCHAR", "content_type": "'text/html'", "body_truncated": "body_truncated::VARCHAR", "redirect_count": "coalesce(chain_n, 0)::VARCHAR", "final_redirect_url": "coalesce(last, '')", "redirect_chain": JSON.format("chain_l"), "technologies": JSON.format("tech_l"), "technology_count": "coalesce(tech_n, 0)::VARCHAR",
    "tls.version": "tls_version", "tls.cipher_suite": "'X'", "tls.key_algorithm": "key_algorithm", "tls.cert_fingerprint_sha256": "cert_fingerprint_sha256", "tls.certificate.subject": "ssl_cert_subject", "tls.certificate.issuer": "ssl_cert_issuer", "tls.certificate.valid_to": "ssl_cert_valid_to_ms::VARCHAR", "tls.certificate.sans": JSON.format("san_l"), "tls.certificate.san_count": "coalesce(san_n, 0)::VARCHAR",
    "dns.nameservers": JSON.format("ns_l"), "dns.nameserver_count": "coalesce(ns_n, 0)::VARCHAR", "dns.txt_record_count": "coalesce(txt_n, 0)::VARCHAR", "dns.mx_records": JSON.format("mx_l"), "dns.mx_record_count": "coalesce(mx_n, 0)::VARCHAR", "dns.cname_count": "coalesce(cname_n, 0)::VARCHAR", "dns.ipv6_count": "coalesce(six_n, 0)::VARCHAR", "dns.caa_count": "coalesce(caa_n, 0)::VARCHAR",
    "analytics_count": "coalesce(ana_n, 0)::VARCHAR", "social_media_count": "coalesce(soc_n, 0)::VARCHAR", "structured_data.count": "coalesce(sd_n, 0)::VARCHAR", "http_header_count": "coalesce(http_n, 0)::VARCHAR", "security_header_count": "coalesce(sec_n, 0)::VARCHAR", "geoip.country_code": "country_code", "geoip.country_name": "country_name", "geoip.region": "region", "geoip.city": "city",
    "whois.registrar": "registrar", "whois.creation_date_ms": "creation_date_ms::VARCHAR", "whois.registrant_country": "registrant_country", "favicon.hash": "CASE WHEN id % 2 = 1 THEN (id % 77 - 30)::VARCHAR END", "favicon.url": "CASE WHEN id % 2 = 1 THEN concat('https://i/', id) END", "contact_link_count": "coalesce(con_n, 0)::VARCHAR", "exposed_secret_count": "coalesce(sct_n, 0)::VARCHAR", "timestamp": "observed_at_ms::VARCHAR",
}
#: Lists of the JSON lines that SQL has as text: their place, the fields shown, what stands between fields and entries, and SQL's text.
JSON_LISTS = {
    "oids": ("tls.certificate.oids", [], "", ",", "oid_s"), "txt_records": ("dns.txt_records", ["record_type", "record_value"], "|", ",", "txt_s"), "cname_records": ("dns.cname_records", [], "", ", ", "cname_s"), "ipv6_addresses": ("dns.ipv6_addresses", [], "", ", ", "six_s"), "caa_records": ("dns.caa_records", ["flag", "tag", "value"], " ", ", ", "caa_s"),
    "analytics_ids": ("analytics_ids", ["provider", "tracking_id"], ":", ",", "ana_s"), "social_media_links": ("social_media_links", ["platform", "url"], ":", ",", "soc_s"), "structured_types": ("structured_data.types", [], "", ",", "sd_t"), "structured_entries": ("structured_data.entries", ["data_type", "property_name", "property_value"], "|", ",", "sd_s"),
    "security_headers": ("security_headers", ["name", "value"], ":", ";", "sec_s"), "partial_failures": ("partial_failures", ["error_type", "error_message"], ":", ",", "fail_s"), "contact_links": ("contact_links", ["contact_type", "contact_value"], ":", ",", "con_s"),
}


def schema_of(kinds: dict[str, str]) -> str:
    """The types of places, by their paths, as one struct's fields."""
    tree: dict[str, list[str]] = {}
    for path in kinds:
        tree.setdefault(path.split(".")[0], []).append(path)
    form = lambda top, paths: kinds[top] if top in kinds else f"struct<{schema_of({p.split('.', 1)[1]: kinds[p] for p in paths})}>"
    return ", ".join(f"`{top}`: {form(top, paths)}" for top, paths in tree.items())


@query("export_jsonl", f"""SELECT {", ".join(f"{v} AS {k.replace('.', '_')}" for k, v in PLACES.items())}, {", ".join(f"coalesce({v[4]}, '') AS list_{k}" for k, v in JSON_LISTS.items())}, response_time_seconds AS response_time, {JSON.format("sct_l")} AS secrets FROM rows""")
def _(t):
    # each line is read once, into a struct of all places: a function of a path would read it again for each
    kinds = {p: "string" for p in PLACES} | {v[0]: f"array<struct<{', '.join(f'{f}: string' for f in v[1])}>>" if v[1] else "array<string>" for v in JSON_LISTS.values()}
    kinds |= {"response_time_ms": "string", "exposed_secrets": "array<struct<type: string, value: string, jwt_claims: string>>"}
    read = lambda path: F.col(f"j.{path}")
    found = F.transform(read("exposed_secrets"), lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"), s["jwt_claims"].isNotNull().alias("claims")))

    def text(path: str, fields: list[str], between: str, sep: str) -> Column:
        return F.array_join(F.transform(read(path), lambda s: F.concat_ws(between, *[s[f] for f in fields]) if fields else s), sep)

    lists = [text(*v[:4]).alias(f"list_{k}") for k, v in JSON_LISTS.items()]
    lines = export.json_lines(whole(t)).select(F.from_json("value", f"struct<{schema_of(kinds)}>").alias("j"))
    return lines.select(*[read(p).alias(p.replace(".", "_")) for p in PLACES], *lists, read("response_time_ms").cast("double").alias("response_time"), F.to_json(found).alias("secrets"))


def listing(name: str, sep: str, *fields: str, between: str = ":", keep=None) -> Column:
    """An array of structs as text: its fields by `between`, its entries by `sep`."""
    form = lambda s: F.concat_ws(between, *[s[f].cast("string") for f in fields]) if fields else s
    return F.array_join(F.transform(F.filter(name, keep) if keep else F.col(name), form), sep)


def as_json(name: str) -> Column:
    return F.to_json(name, {"ignoreNullFields": "false"})


#: Every column of the nested rows, and what SQL says of it.
FACT_NAMES = ["url", "initial_domain", "final_domain", "initial_url", "final_url", "ip_address", "http_status", "http_status_text", "response_time_seconds", "title", "description", "meta_robots", "body_sha256", "content_length", "http_version", "canonical_url", "tls_version", "ssl_cert_subject", "ssl_cert_issuer", "ssl_cert_valid_to_ms", "key_algorithm", "cert_fingerprint_sha256", "spf_record", "dmarc_record", "observed_at_ms", "run_id"]
PARQUET = {name: name for name in FACT_NAMES} | {
    "reverse_dns": "reverse_dns_name", "content_type": "'text/html'", "body_truncated": "CASE WHEN body_truncated THEN true END", "cipher_suite": "'X'", "redirect_count": "coalesce(chain_n, 0)::INTEGER", "final_redirect_url": "coalesce(last, '')",
    "redirect_chain": JSON.format("list_transform(chain_l, lambda x: {'redirect_url': x.redirect_url, 'sequence_order': x.sequence_order})"), "technology_count": "coalesce(tech_n, 0)::INTEGER", "technologies": JSON.format("tech_l"), "certificate_sans": JSON.format("san_l"), "nameservers": JSON.format("ns_l"),
    "oids": "coalesce(oid_s, '')", "cname_records": "coalesce(cname_s, '')", "ipv6_addresses": "coalesce(six_s, '')", "caa_records": "coalesce(caa_s, '')", "txt_records": "coalesce(txt_s, '')", "mx_records": "coalesce(mx_s, '')", "analytics_ids": "coalesce(ana_s, '')", "social_media_links": "coalesce(soc_s, '')",
    "structured_data": "coalesce(sd_s, '')", "http_headers": "coalesce(http_s, '')", "security_headers": "coalesce(sec_s, '')", "partial_failures": "coalesce(fail_s, '')", "contact_links": "coalesce(con_s, '')", "exposed_secrets": "coalesce(sct_s, '')", "contact_link_count": "coalesce(con_n, 0)::INTEGER", "exposed_secret_count": "coalesce(sct_n, 0)::INTEGER",
    "geoip_country_code": "country_code", "geoip_country_name": "country_name", "geoip_region": "region", "geoip_city": "city", "geoip_latitude": "NULL::DOUBLE", "geoip_longitude": "NULL::DOUBLE", "geoip_asn": "NULL::BIGINT", "geoip_asn_org": "NULL::VARCHAR",
    "whois_registrar": "registrar", "whois_creation_date_ms": "creation_date_ms", "whois_expiration_date_ms": "NULL::BIGINT", "whois_registrant_country": "registrant_country", "favicon_hash": "CASE WHEN id % 2 = 1 THEN (id % 77 - 30)::INTEGER END", "favicon_url": "CASE WHEN id % 2 = 1 THEN concat('https://i/', id) END",
}


@query("export_parquet", f"SELECT {', '.join(f'{v} AS {k}' for k, v in PARQUET.items())}, coalesce(soc_i, '') AS identifiers FROM rows")
def _(t):
    rows = export.parquet_rows(whole(t))
    shown = {
        **{c: as_json(c) for c in ("redirect_chain", "technologies", "certificate_sans", "nameservers")}, "oids": listing("oids", ","), "cname_records": listing("cname_records", ", "), "ipv6_addresses": listing("ipv6_addresses", ", "), "caa_records": listing("caa_records", ", ", "flag", "tag", "value", between=" "),
        "txt_records": listing("txt_records", ",", "record_type", "content", between="|"), "mx_records": listing("mx_records", ",", "priority", "mail_exchange"), "analytics_ids": listing("analytics_ids", ",", "provider", "tracking_id"), "social_media_links": listing("social_media_links", ",", "platform", "url"),
        "structured_data": listing("structured_data", ",", "data_type", "property_name", "property_value", between="|"), "http_headers": listing("http_headers", ";", "name", "value", keep=lambda h: h["name"] != "ETag"), "security_headers": listing("security_headers", ";", "name", "value"),
        "partial_failures": listing("partial_failures", ",", "error_type", "error_message"), "contact_links": listing("contact_links", ",", "contact_type", "contact_value"), "exposed_secrets": F.array_join(F.transform("exposed_secrets", export.secret_text), "; "),
    }
    assert set(rows.columns) == set(PARQUET), set(rows.columns) ^ set(PARQUET)
    who = F.array_join(F.filter(F.transform("social_media_links", lambda s: F.when(s["identifier"].isNotNull(), F.concat_ws(":", s["platform"], s["identifier"]))), lambda x: x.isNotNull()), ",")
    return rows.select(*[shown.get(c, F.col(c)).alias(c) for c in rows.columns], who.alias("identifiers"))
