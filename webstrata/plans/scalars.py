"""Queries over the scalar functions. Their inputs are raw texts built from keys of the driver's tables; the SQL says, from
the same keys, what has to come out, without parsing anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import binary as B
from webstrata.functions import domains as D
from webstrata.functions import scalar as S
from webstrata.operators import geo, secrets
from webstrata.plans.bridge import say

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """A plan over customers as k; the SQL has them as a table c."""

    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")), F.col("k"))
        SQL[name] = f"WITH c AS (SELECT c_custkey AS k FROM customer) {sql}"
        return plan

    return add


def variant(n: int, *texts: Column | str | None) -> Column:
    """One of the texts, by k mod n."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        out = F.when(F.col("k") % n == i, t if isinstance(t, Column) else F.lit(t)).otherwise(out)
    return out


@query("scalar_dns", """SELECT k, CASE WHEN k % 3 = 0 THEN ' v=spf1 include:' || k END AS spf, CASE k % 4 WHEN 0 THEN 'v=DMARC1; p=' || k WHEN 1 THEN 'v=DMARC1; sub=' || k END AS dmarc,
CASE k % 8 WHEN 0 THEN k % 60 WHEN 3 THEN -(k % 9) - 1 WHEN 4 THEN k % 5 WHEN 1 THEN 0 WHEN 6 THEN 0 END::INTEGER AS mx_priority, CASE k % 8 WHEN 0 THEN 'mx' || k WHEN 1 THEN 'only' || k WHEN 3 THEN 'minus' || k WHEN 4 THEN 'json' || k WHEN 6 THEN 'junk' || k END AS mx_host,
CASE k % 4 WHEN 0 THEN (k % 7) || ' a' || k || ',20 b' WHEN 1 THEN '10 m' || k || ',0 n' END AS mx_list, CASE WHEN k % 2 = 0 THEN 'a' || k || '|b' END AS strings FROM c""")
def _(c, k):
    txt = F.when(k % 3 == 0, F.array(say("x", k), say(" v=spf1 include:", k), F.lit("v=spf1 second"))).otherwise(F.array(say("V=SPF1 ", k)))
    apex, sub = F.array(F.lit("other"), F.when(k % 4 == 0, say("v=DMARC1; p=", k)).otherwise("v=dmarc1 lower")), F.when(k % 4 < 2, F.array(say("v=DMARC1; sub=", k)))
    mx = S.mx_entry(variant(8, say(k % 60, "  mx", k), say("only", k), say(k), say(-(k % 9) - 1, " minus", k), say('{"priority": ', k % 5, ', "hostname": "json', k, '"}'), "", say("junk", k, " host"), None))
    many = S.mx_entries(variant(4, say('[{"priority": ', k % 7, ', "hostname": "a', k, '"}, {"hostname": "lost"}, {"priority": 20, "hostname": "b"}]'), say('["10 m', k, '", "n", "30"]'), "[]", "no json"))
    return c.select("k", S.first_spf(txt).alias("spf"), S.first_dmarc(apex, sub).alias("dmarc"), mx["priority"].alias("mx_priority"), mx["mail_exchange"].alias("mx_host"), F.array_join(F.transform(many, lambda m: F.concat_ws(" ", m["priority"].cast("string"), m["mail_exchange"])), ",").alias("mx_list"), F.array_join(S.json_strings(F.when(k % 2 == 0, say('["a', k, '", "b"]')).otherwise("[1")), "|").alias("strings"))


@query("scalar_hsts", "SELECT k, CASE WHEN k % 5 < 4 THEN k * 1000 END AS max_age, k % 2 = 0 AS include_subdomains, k % 3 = 0 AS preload FROM c")
def _(c, k):
    parts = F.concat(F.when(k % 5 == 4, "max-age=soon").when(k % 5 == 3, say("MAX-AGE=", k * 1000)).otherwise(say("max-age=", k * 1000)), F.when(k % 2 == 0, "; includeSubDomains").otherwise(""), F.when(k % 3 == 0, " ;Preload").otherwise(""))
    return c.select("k", S.hsts(parts).alias("h")).select("k", "h.*")


@query("scalar_csp", "SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [{'directive': 'default-src', 'fqdn': 'a' || k || '.example.com'}, {'directive': 'img-src', 'fqdn': 'cdn' || (k % 5) || '.net'}, {'directive': 'img-src', 'fqdn': 'a' || k || '.example.com'}] ELSE [{'directive': 'script-src', 'fqdn': 'x.org'}] END, recursive := true) FROM c")
def _(c, k):
    policy = F.when(k % 2 == 0, say("default-src 'self' https://A", k, ".example.com a", k, ".example.com; ; img-src data: *.cdn", k % 5, ".net wss://a", k, ".example.com:443/x localhost")).otherwise("Script-Src x.org 'none' https:; report-uri /x")
    return c.select("k", F.explode(S.csp_domains(policy)).alias("d")).select("k", "d.*")


@query("scalar_cookies", "SELECT k, 'sid' || k AS cookie_name, k % 2 = 0 OR k % 7 = 0 AS secure, k % 3 = 0 AS http_only, CASE WHEN k % 5 < 3 THEN 'lax' END AS same_site, CASE WHEN k % 4 = 0 THEN 'D' || k || '.Example' END AS domain, '/p' || k AS path FROM c")
def _(c, k):
    text = F.concat(say("sid", k, "=", F.when(k % 7 == 0, "insecure").otherwise("v")), say("; Path=/p", k), F.when(k % 2 == 0, "; Secure").otherwise(""), F.when(k % 3 == 0, "; HttpOnly").otherwise(""), F.when(k % 5 < 3, "; SameSite=LAX").otherwise(""), F.when(k % 4 == 0, say("; domain=D", k, ".Example")).otherwise(""))
    return c.select("k", S.cookie(text).alias("x")).select("k", "x.*")


@query("scalar_headers", """SELECT k, kind, name AS header_name, name || k AS header_value FROM c, (VALUES ('http', 'Server', 1), ('http', 'ETag', 2), ('http', 'X-Robots-Tag', 3), ('security', 'X-Frame-Options', 1), ('security', 'Content-Security-Policy', 2)) v(kind, name, m) WHERE k % m = 0""")
def _(c, k):
    names = ((("Server", "sErVeR"), 1), (("ETag", "etag"), 2), (("X-Robots-Tag", "x-robots-tag"), 3), (("X-Frame-Options", "X-FRAME-OPTIONS"), 1), (("Content-Security-Policy", "content-security-policy"), 2), (("No-Such", "no-such"), 1))
    sent = F.map_from_entries(F.filter(F.array(*[F.when(k % m == 0, F.struct(F.lit(raw), say(name, k))) for (name, raw), m in names]), lambda e: e.isNotNull()))
    rows = c.select("k", sent.alias("h"))
    each = lambda kind, known: rows.select("k", F.lit(kind).alias("kind"), F.explode(S.header_rows("h", known)).alias("x")).select("k", "kind", "x.*")
    return each("http", S.HTTP_HEADERS).unionByName(each("security", S.SECURITY_HEADERS))


@query("scalar_urls", """SELECT k, CASE k % 6 WHEN 0 THEN 'https://s' || k || '.example.com/a' WHEN 1 THEN 'http://s' || k || '.example.com' END AS normalized, CASE WHEN k % 6 < 2 THEN 's' || k || '.example.com' END AS host, 'https://e.com/' || CASE k % 6 WHEN 0 THEN 'x/p' || k WHEN 1 THEN 'p' || k WHEN 2 THEN 'x/y?q=' || k WHEN 3 THEN 'p' || k || '/' WHEN 4 THEN 'x/y?o=1#f' || k ELSE 'x/y/p' END AS joined, 'A' || k || ' é%zz+' AS decoded,
'https://e.com' || CASE WHEN k % 2 = 0 THEN '/icons/' || k || '.png' ELSE '/favicon.ico' END AS icon FROM c""")
def _(c, k):
    normal = S.normalized_url(variant(6, say(" s", k, ".example.com/a "), say("http://s", k, ".example.com"), say("ftp://s", k, ".example.com"), "", F.repeat(say("x", k), 1100), "http://"))
    ref = variant(6, say("p", k), say("/p", k), say("?q=", k), say("../p", k, "/"), say("?o=1#f", k), "y/p")
    return c.select("k", normal.alias("normalized"), S.url_host(normal).alias("host"), D.url_join(F.lit("https://e.com/x/y"), ref).alias("joined"), D.percent_decoded(say("%41", k, "%20%C3%A9%zz+")).alias("decoded"), B.favicon_url(F.lit("https://e.com/x/y"), F.when(k % 2 == 0, say("/icons/", k, ".png"))).alias("icon"))


SUFFIXES = ["com", "co.uk", "co.at", "com.pl", "github.io", "kobe.jp", "nosuch", "gov.br"]


@query("scalar_domains", f"""SELECT k, host, CASE WHEN suffix = 'kobe.jp' THEN 'www.s' || k ELSE 's' || k END || '.' || suffix AS registrable, CASE WHEN suffix = 'kobe.jp' THEN 'www.s' || k ELSE 's' || k END || '.' || suffix AS root, suffix NOT IN ('com', 'nosuch') AS suffix_is_root FROM (SELECT k, suffix, 'a.www.s' || k || '.' || suffix AS host FROM c JOIN (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SUFFIXES))}) v(i, suffix) ON k % {len(SUFFIXES)} = i)""")
def _(c, k):
    suffix = variant(len(SUFFIXES), *SUFFIXES)
    host = say("A.www.s", k, ".", suffix)
    rows = c.select("k", F.lower(host).alias("host"), host.alias("raw"), suffix.alias("suffix"))
    return rows.select("k", "host", D.registrable("raw").alias("registrable"), D.root_domain("host").alias("root"), D.root_domain("suffix").isNotNull().alias("suffix_is_root"))


@query("scalar_targets", "SELECT k, CASE k % 12 WHEN 0 THEN true WHEN 1 THEN k % 100 <> 0 WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN (k % 200) NOT IN (0, 10, 127) WHEN 5 THEN false WHEN 6 THEN k % 2 = 0 WHEN 7 THEN false WHEN 8 THEN false WHEN 9 THEN k % 16 < 12 ELSE false END AS allowed FROM c")
def _(c, k):
    hexed = lambda n: F.lower(F.hex(n.cast("long")))
    urls = variant(
        12, say("https://s", k, ".example.com/"), F.when(k % 100 == 0, "http://localhost:8080/").otherwise(say("http://local", k, ".com/")), say("http://[::ffff:7f00:", hexed(k % 60000), "]/"), say("http://", F.lit(2130706432) + k % 1000, "/"),
        say("http://", F.when((k % 200).isin(100, 169, 172, 192, 198), 11).otherwise(k % 200), ".9.0.7/"), say("ftp://s", k, ".com/"), F.when(k % 2 == 0, "http://[2606:4700::1111]/").otherwise("http://[fd00:1::2]/"), "http://[0:0::1]:80/", "http://0x7f.1/", say("http://172.", F.lit(4) + k % 16, ".1.1/"), "http://[2001:db8::5]/", None,
    )
    return c.select("k", F.coalesce(S.allowed_target(urls), F.lit(False)).alias("allowed"))


@query("scalar_labels", """SELECT k, s AS status, CASE s WHEN 200 THEN 'OK' WHEN 301 THEN 'Moved Permanently' WHEN 403 THEN 'Forbidden' WHEN 404 THEN 'Not Found' WHEN 429 THEN 'Too Many Requests' WHEN 503 THEN 'Service Unavailable' ELSE 'Unknown Status Code' END AS label, s NOT IN (429, 503) AS captured,
CASE s WHEN 403 THEN 'Bot detection (403 Forbidden)' WHEN 404 THEN 'Not Found (404)' WHEN 429 THEN 'Too many requests' WHEN 503 THEN 'Service Unavailable (503)' WHEN 418 THEN 'HTTP request other error' END AS status_error, s IN (429, 503) AS retriable,
['RSA', 'ECDSA', 'Ed25519', 'Ed448', '1.2.' || k][k % 5 + 1] AS algorithm, CASE k % 3 WHEN 0 THEN 'TLSv1.3' WHEN 1 THEN 'SSLv3' ELSE 'Unknown' END AS tls, k % 4 < 3 AS scannable, CASE k % 3 WHEN 0 THEN k::VARCHAR || '.1' END AS version
FROM (SELECT k, [200, 301, 403, 404, 429, 503, 418][k % 7 + 1] AS s FROM c)""")
def _(c, k):
    s = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 403, 404, 429, 503, 418)]), (k % 7 + 1).cast("int"))
    oid = variant(5, "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.3.101.112", "1.3.101.113", say("1.2.", k))
    kind = variant(4, "Text/HTML; charset=x", "application/vnd.x+JSON", "application/xhtml+xml", "image/png")
    rows = c.withColumn("status", s)
    return rows.select("k", "status", S.status_text("status").alias("label"), S.captured("status").alias("captured"), S.status_error("status").alias("status_error"), S.retriable("status", F.lit(None).cast("string")).alias("retriable"), S.key_algorithm(oid).alias("algorithm"), S.tls_label(variant(3, "TLSv1.3", "SSLv3", "TLS 9")).alias("tls"), S.scannable_type(kind).alias("scannable"), S.version_text(variant(3, say(" ", k, ".1 "), "deadbeef123", "  ")).alias("version"))


@query("scalar_errors", """SELECT k, ['HTTP request timeout error', 'Process URL timeout', 'DNS TXT lookup error', 'DNS MX lookup error', 'DNS NS lookup error', 'TLS certificate error', 'HTTP request other error'][k % 7 + 1] AS error_type, k % 7 < 2 OR k % 7 IN (2, 3, 4) AS retriable,
'e' || k || CASE WHEN k % 32 IN (9, 10, 13) THEN chr((k % 32)::INTEGER) ELSE '' END || chr(127) || 'é' AS clean, CASE WHEN k % 2 = 0 THEN repeat('é', 4) || '...' ELSE 'short' || (k % 10) END AS cut, k // 1000 + CASE WHEN k % 1000 >= 500 THEN 1 ELSE 0 END AS ms FROM c""")
def _(c, k):
    message = variant(7, say("HTTP call: Timeout after ", k), say("timeout ", k), "DNS: no TXT", "resolve failed for mail", "Lookup failed", "bad Certificate", "odd")
    error = S.message_error(message)
    return c.select("k", error.alias("error_type"), S.retriable(F.lit(None).cast("int"), error).alias("retriable"), S.sanitized(F.concat(F.lit("e"), k.cast("string"), F.char(F.when(k % 32 == 0, 1).otherwise(k % 32)), F.char(F.lit(127)), F.lit("é"))).alias("clean"), S.truncated_utf8(F.when(k % 2 == 0, F.repeat(F.lit("é"), 9)).otherwise(say("short", k % 10)), 12).alias("cut"), S.micros_to_millis(k).alias("ms"))


@query("scalar_certificates", "SELECT k, k % 5 = 0 AS self_signed, k % 3 = 0 AS wildcard, CASE WHEN k % 3 = 0 THEN k % 2 = 1 ELSE k % 7 <> 0 END AS mismatched FROM c")
def _(c, k):
    # hosts: one or two labels under a wildcard's base; plain names match by subject only where k % 7 = 0
    host = F.when(k % 3 == 0, F.when(k % 2 == 0, say("w.d", k, ".com")).otherwise(say("v.w.d", k, ".com"))).otherwise(say("H", k, ".org"))
    subject = F.when(k % 7 == 0, say("O=x, CN=h", k, ".org")).otherwise("O=x, CN=else.net")
    issuer = F.when(k % 5 == 0, subject).otherwise("CN=Issuer")
    sans = F.when(k % 3 == 0, F.array(F.lit("a.b"), say("*.D", k, ".com"))).otherwise(F.array(F.lit("a.b")))
    return c.select("k", S.cert_flags(subject, issuer, sans, host).alias("f")).select("k", "f.*")


@query("scalar_whois", """SELECT k, CASE WHEN k % 8 < 6 THEN (k % 20000) * 86400000 + CASE k % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3723000 WHEN 3 THEN 3723000 WHEN 4 THEN -3477000 ELSE 3723456 END END AS created_ms, 'Org ' || k AS org, CASE WHEN k % 2 = 0 THEN 'C' || (k % 9) END AS country FROM c WHERE k % 20000 > 0""")
def _(c, k):
    day = F.date_add(F.lit("1970-01-01").cast("date"), (k % 20000).cast("int"))
    text = variant(8, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd-MMM-yyyy"), F.concat(day.cast("string"), F.lit("T01:02:03Z")), F.concat(day.cast("string"), F.lit(" 01:02:03")), F.concat(day.cast("string"), F.lit("T01:02:03+02:00")), F.concat(day.cast("string"), F.lit("T01:02:03.456Z")), "1970-01-01", "never")
    raw = F.concat(F.lit("Domain: x\nregistrant organization:  \nRegistrant Organization: Org "), k.cast("string"), F.lit("\r\n"), F.when(k % 2 == 0, say("  REGISTRANT COUNTRY : C", k % 9)).otherwise("Registrant Country:"))
    return c.where("k % 20000 > 0").select("k", S.whois_ms(text).alias("created_ms"), S.whois_field(raw, "Registrant Organization").alias("org"), S.whois_field(raw, "Registrant Country").alias("country"))


def url_safe(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(x.cast("binary")), "+/", "-_"), "[=\r\n]", "")


@query("scalar_tokens", """SELECT k, CASE WHEN k % 6 < 4 THEN 'HS' || (k % 3) END AS algorithm, CASE WHEN k % 6 < 4 THEN 'iss' || k END AS issuer, CASE WHEN k % 6 < 4 THEN CASE WHEN k % 2 = 0 THEN '["a","b' || k || '"]' ELSE 'aud' || k END END AS audience, CASE WHEN k % 6 < 4 THEN k * 1000 END AS expiration_ms, CASE WHEN k % 6 < 4 THEN -1000 END AS not_before_ms, 'é?' || k AS plain FROM c""")
def _(c, k):
    head = say('{"alg":"HS', k % 3, '","typ":"JWT"}')
    body = say('{"iss":"iss', k, '","aud":', F.when(k % 2 == 0, say('["a","b', k, '"]')).otherwise(say('"aud', k, '"')), ',"exp":', k, ',"nbf":-1.9}')
    token = F.concat(url_safe(head), F.lit("."), url_safe(body), F.lit(".c2ln"))
    sent = variant(6, token, F.concat(token, F.lit("\\")), url_safe(token), token, F.concat(token, F.lit(".x")), "a.b.c")
    rows = c.select("k", S.wrapped_jwt(sent).alias("t"), S.base64url(url_safe(say("é?", k))).alias("plain"))
    return rows.select("k", "t.algorithm", "t.issuer", "t.audience", "t.expiration_ms", "t.not_before_ms", "plain")


@query("token_claims", """SELECT k, 'HS256' AS algorithm, 'me' || k AS issuer, k * 1000 AS expiration_ms FROM c WHERE k % 3 = 0""")
def _(c, k):
    token = F.concat(url_safe(F.lit('{"alg":"HS256"}')), F.lit("."), url_safe(say('{"iss":"me', k, '","exp":', k, "}")), F.lit(".c2lnbmF0dXJl"))
    headers = F.create_map(F.lit("X-Token"), F.when(k % 3 == 0, token).otherwise("none"), F.lit("Set-Cookie"), F.lit("a=1"))
    rows = c.select("k", F.lit("<p>x</p>").alias("html"), headers.alias("h"))
    found = secrets.exposed_of_answers(rows, "k", "html", headers="h")
    return secrets.token_claims(found, "k").select("k", "algorithm", "issuer", "expiration_ms")


@query("answer_secrets", """SELECT k, 'aws-access-key' AS secret_type, key AS matched_value, place AS location FROM (SELECT k, 'AKIA' || lpad((k * 7919)::VARCHAR, 10, '7') || 'QWERTZ' AS key, [NULL, 'response_header', 'set_cookie', 'external_script:https://a.com/' || k || '.js', 'html_comment', 'data_attribute', 'inline_script', 'html_body', 'url_parameter', 'meta_tag'][k % 10 + 1] AS place FROM c) WHERE place IS NOT NULL""")
def _(c, k):
    key = F.concat(F.lit("AK"), F.lit("IA"), F.lpad((k * 7919).cast("string"), 10, "7"), F.lit("QWERTZ"))
    html = F.coalesce(variant(10, None, None, None, None, say("<!-- ", key, " --><p>"), say('<div data-key="', key, '">'), say("<script>k='", key, "'</script>"), say("<p>", key, "</p>"), say('<img alt=x> https://x.com/?k=', key, " "), say('<meta name="k" content="', key, '">')), F.lit("<p>nothing</p>"))
    rows = c.select("k", html.alias("html"), F.create_map(F.lit("X-Key"), F.when(k % 10 == 1, key).otherwise("-")).alias("h"), F.array(F.when(k % 10 == 2, say("c=", key)).otherwise("c=1")).alias("s"), F.create_map(say("https://a.com/", k, ".js"), F.when(k % 10 == 3, say("var k='", key, "'")).otherwise("-")).alias("x"))
    return secrets.exposed_of_answers(rows, "k", "html", "h", "s", "x").select("k", "secret_type", "matched_value", "location")


@query("scalar_bodies", "SELECT k, CASE k % 5 WHEN 4 THEN '' ELSE 'é' || k END AS text, 'é' || k || '!' AS latin FROM c")
def _(c, k):
    body = variant(5, *[say("é", k)] * 4, "")
    sent = F.when(k % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).when(k % 5 == 2, F.encode(body, "UTF-16")).otherwise(F.encode(body, "UTF-8"))
    kind = F.when(k % 5 == 3, "text/html; charset=utf-8")
    return c.select("k", B.decode_body(sent, kind).alias("text"), B.decode_body(F.encode(say("é", k, "!"), "ISO-8859-1"), F.lit("text/html; Charset=ISO-8859-1")).alias("latin"))


@query("network_lookup_v6", "SELECT k, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 40 < 25 THEN 'net' || (k % 40) ELSE 'rest' END AS name FROM c")
def _(c, k):
    spark = c.sparkSession
    nets = spark.range(25).select(say("2001:db8:", F.lower(F.hex("id")), "::/48").alias("network"), say("net", F.col("id")).alias("name")).unionByName(spark.createDataFrame([("2001:db8::/32", "rest")], "network string, name string"))
    ip = F.when(k % 4 == 3, "fe80::1").otherwise(say("2001:0DB8:", F.lower(F.hex(k % 40)), ":0::", F.lower(F.hex(k % 999))))
    return geo.locate(c.select("k", ip.alias("ip_address")), geo.networks(nets)).select("k", "name")
