"""Scalar functions on columns: parsers, labels and normalisers that need no Python at run time, but for literal addresses."""

from __future__ import annotations

import socket
from functools import lru_cache
from ipaddress import IPv6Address, IPv6Network

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time -------------------------------------------------------------------------------------------------------------


def epoch_text(ms: Column | str) -> Column:
    """Epoch milliseconds as 'yyyy-MM-dd HH:mm:ss' in UTC, by arithmetic: the session's time zone plays no part."""
    s = F.floor(col(ms) / 1000).cast("long")
    rest = F.pmod(s, F.lit(86_400))
    clock = [F.lpad(x.cast("long").cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)]
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86_400).cast("int")).cast("string"), F.lit(" "), F.concat_ws(":", *clock))


def epoch_date(ms: Column | str) -> Column:
    """Epoch milliseconds as 'yyyy-MM-dd', '' where null."""
    return F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(ms) / DAY_MS).cast("int")).cast("string"), F.lit(""))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two instants in milliseconds, cut toward zero."""
    return ((later - earlier) / float(DAY_MS)).cast("int")


def micros_to_millis(x: Column | str) -> Column:
    return F.floor((col(x) + 500) / 1000).cast("long")


# --- URLs and predicates ----------------------------------------------------------------------------------------------


def url_host(url: Column | str) -> Column:
    """Host in lower case, null where the URL doesn't parse."""
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def normalized_url(url: Column | str, longest: int = 2048) -> Column:
    """A scheme is added where there is none; null for other schemes than http and https, or over `longest` bytes before or after."""
    u = F.trim(col(url))
    whole = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    fine = (F.octet_length(u) <= longest) & (F.octet_length(whole) <= longest) & scheme.isin("http", "https") & (F.coalesce(url_host(whole), F.lit("")) != "")
    return F.when(fine, whole)


def display_url(domain: Column | str) -> Column:
    d = col(domain)
    return F.when(d.startswith("http://") | d.startswith("https://"), d).otherwise(F.concat(F.lit("https://"), d))


#: Ranges that a scanner must not reach (first, last address); fixed values.
FORBIDDEN_IPV4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
]


def ipv4_number(ip: Column | str) -> Column:
    """A dotted quad as a long, null for anything else."""
    parts = [F.try_to_number(F.regexp_extract(col(ip), r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k), F.lit("999")).cast("long") for k in range(1, 5)]
    value = parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * 256 + parts[3]
    return F.when(F.greatest(*parts) <= 255, value)


def quad(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def reachable_ipv4(ip: Column | str) -> Column:
    """False in a forbidden range, null if not a dotted quad."""
    n = ipv4_number(ip)
    bad = F.lit(False)
    for low, high in FORBIDDEN_IPV4:
        bad = bad | n.between(quad(low), quad(high))
    return ~bad


#: IPv6 networks that a scanner must not reach; fixed values.
FORBIDDEN_IPV6 = ["::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32"]


@lru_cache(maxsize=1 << 16)
def reachable(literal: str) -> bool:
    """Whether an address, written in any way that URLs allow, is outside the forbidden ranges; wrapped IPv4 counts as such."""
    if literal.startswith("["):
        try:
            six = IPv6Address(literal[1:-1].split("%")[0])
        except ValueError:
            return False
        if six.ipv4_mapped is None:
            return not any(six in IPv6Network(n) for n in FORBIDDEN_IPV6)
        number = int(six.ipv4_mapped)
    else:
        try:
            number = int.from_bytes(socket.inet_aton(literal))
        except OSError:
            return False
    return not any(quad(low) <= number <= quad(high) for low, high in FORBIDDEN_IPV4)


def reachable_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda x: reachable(x) if isinstance(x, str) else None)


def reachable_literal(host: Column | str) -> Column:
    """False for a host that is a forbidden or broken address, null for a name. IPv4 may be short, hexadecimal, octal or one number, as
    URLs have it. Only addresses are sent to Python."""
    h = F.lower(F.regexp_replace(col(host), r"\.$", ""))
    address = h.startswith("[") | h.rlike(r"^(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+)){0,3}$")
    return F.pandas_udf(reachable_batch, "boolean")(F.when(address, h))


def allowed_target(url: Column | str) -> Column:
    """Whether a scanner may fetch the URL: http(s), no local name, no forbidden literal address."""
    host = F.regexp_replace(F.coalesce(url_host(url), F.lit("")), r"\.$", "")
    scheme = F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("PROTOCOL")), F.lit("")))
    local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    return scheme.isin("http", "https") & (host != "") & ~local & F.coalesce(reachable_literal(host), F.lit(True))


def scannable_type(content_type: Column | str) -> Column:
    """Whether a body of this content type is text that can be searched; a missing type counts as text."""
    t = F.trim(F.lower(F.split(col(content_type), ";")[0]))
    fixed = [f"application/{x}" for x in ("xhtml+xml", "javascript", "ecmascript", "x-javascript", "json", "manifest+json", "ld+json", "xml", "atom+xml", "rss+xml", "soap+xml")]
    return F.coalesce(t.startswith("text/") | t.isin(fixed) | t.endswith("+json") | t.endswith("+xml") | (t == ""), F.lit(True))


def captured(status: Column | str) -> Column:
    """Every answer but 429 and 5xx is an observation."""
    return (col(status) != 429) & ~col(status).between(500, 599)


def not_like(x: Column | str, pattern: str) -> Column:
    """NOT LIKE without regard to ASCII case; null stays null, so such rows drop out."""
    return ~col(x).ilike(pattern)


# --- DNS --------------------------------------------------------------------------------------------------------------


def first_spf(records: Column | str) -> Column:
    return F.get(F.filter(col(records), lambda x: F.trim(x).startswith("v=spf1")), F.lit(0))


def first_dmarc(apex: Column | str, sub: Column | str | None = None) -> Column:
    pick = lambda r: F.get(F.filter(col(r), lambda x: F.trim(x).startswith("v=DMARC1")), F.lit(0))
    return pick(apex) if sub is None else F.coalesce(pick(apex), pick(sub))


def txt_kind(record: Column | str) -> Column:
    r = F.lower(col(record))
    return F.when(r.startswith("v=spf1"), "SPF").when(r.startswith("v=dmarc1"), "DMARC").when(F.contains(r, F.lit("verification")) | F.contains(r, F.lit("verify")), "VERIFICATION").otherwise("OTHER")


def mx_entry(record: Column | str) -> Column:
    """struct(priority, mail_exchange) of 'priority host', a signed number first; of other text, its first word with priority 0; of a JSON
    object, its priority and hostname (or exchange); null for a lone number or nothing."""
    t = F.trim(col(record))
    words = F.split(t, r"\s+")
    number = F.when(words[0].rlike(r"^[+-]?\d{1,10}$"), words[0].try_cast("int"))
    of = lambda priority, host: F.struct(priority.cast("int").alias("priority"), host.alias("mail_exchange"))
    obj = F.from_json(F.when(t.startswith("{"), t), "priority int, hostname string, exchange string, mail_exchange string")
    host = F.coalesce(obj["hostname"], obj["exchange"], obj["mail_exchange"])
    plain = F.when(number.isNull(), F.when(words[0] != "", of(F.lit(0), words[0]))).when(F.size(words) >= 2, of(number, words[1]))
    return F.when(t.startswith("{"), F.when(host.isNotNull(), of(F.coalesce(obj["priority"], F.lit(0)), host))).otherwise(plain)


def mx_entries(records: Column | str) -> Column:
    """array<struct(priority, mail_exchange)> of a JSON array of objects with priority and hostname, or else of strings; null if nothing comes out."""
    r = col(records)
    objects = F.filter(F.from_json(r, "array<struct<priority: bigint, hostname: string>>"), lambda x: x["priority"].isNotNull() & x["hostname"].isNotNull())
    named = F.transform(objects, lambda x: F.struct(x["priority"].cast("int").alias("priority"), x["hostname"].alias("mail_exchange")))
    texts = F.filter(F.from_json(r, "array<string>"), lambda x: ~x.startswith("{"))
    plain = F.filter(F.transform(texts, mx_entry), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named).when(F.size(plain) > 0, plain)


def json_strings(x: Column | str) -> Column:
    """A JSON array of strings, null where it is none or empty."""
    a = F.from_json(col(x), "array<string>")
    return F.when(F.size(a) > 0, a)


# --- headers ----------------------------------------------------------------------------------------------------------

#: Header names that are stored, as they are written; fixed values.
SECURITY_HEADERS = ["Content-Security-Policy", "Strict-Transport-Security", "X-Content-Type-Options", "X-Frame-Options", "X-XSS-Protection", "Referrer-Policy", "Permissions-Policy"]
HTTP_HEADERS = ["Server", "X-Powered-By", "X-Generator", "CF-Ray", "X-Served-By", "Via", "Server-Timing", "X-Cache", "Cache-Control", "ETag", "Last-Modified", "Link", "Alt-Svc", "Accept-CH", "Critical-CH", "Clear-Site-Data", "Report-To", "NEL", "X-Robots-Tag"]


def header_rows(headers: Column | str, names: list[str]) -> Column:
    """array<struct(header_name, header_value)> of those of `names` that a map has, in any case, under their written names."""
    pick = lambda n: F.get(F.filter(F.map_entries(col(headers)), lambda e: F.lower(e["key"]) == n.lower()), F.lit(0))["value"]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("header_name"), pick(n).alias("header_value")) for n in names]), lambda s: s["header_value"].isNotNull())


def hsts(value: Column | str) -> Column:
    """struct(max_age, include_subdomains, preload) of a Strict-Transport-Security header."""
    parts = F.transform(F.split(col(value), ";"), lambda p: F.lower(F.trim(p)))
    age = F.get(F.filter(parts, lambda p: p.startswith("max-age")), F.lit(0))
    return F.struct(F.try_to_number(F.nullif(F.regexp_extract(age, r'^max-age\s*=\s*"?(\d{1,18})"?$', 1), F.lit("")), F.lit("9" * 18)).cast("long").alias("max_age"), F.array_contains(parts, "includesubdomains").alias("include_subdomains"), F.array_contains(parts, "preload").alias("preload"))


def csp_domains(policy: Column | str) -> Column:
    """array<struct(directive, fqdn)> of the host names that a policy lists, distinct, in lower case."""
    parts = F.filter(F.transform(F.split(col(policy), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def each(p: Column) -> Column:
        words = F.split(p, r"\s+")
        hosts = F.transform(F.slice(words, 2, 10_000), lambda w: F.regexp_extract(F.lower(w), r"^(?:[a-z][a-z0-9+.-]*://)?(?:\*\.)?((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,})(?:[:/].*)?$", 1))
        return F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.struct(F.lower(words[0]).alias("directive"), h.alias("fqdn")))

    return F.array_distinct(F.flatten(F.transform(parts, each)))


def cookie(value: Column | str) -> Column:
    """struct(name, secure, http_only, same_site, domain, path) of a Set-Cookie value. `secure` and `httponly` are looked for anywhere in it."""
    c = col(value)
    low = F.lower(c)
    parts = F.transform(F.split(c, ";"), lambda p: F.trim(p))
    attr = lambda n: F.get(F.transform(F.filter(parts, lambda p: F.lower(p).startswith(n + "=")), lambda p: F.substring(p, F.lit(len(n) + 2), F.length(p))), F.lit(0))
    return F.struct(F.trim(F.split(parts[0], "=", 2)[0]).alias("cookie_name"), F.contains(low, F.lit("secure")).alias("secure"), F.contains(low, F.lit("httponly")).alias("http_only"), F.lower(attr("samesite")).alias("same_site"), attr("domain").alias("domain"), attr("path").alias("path"))


# --- bodies -----------------------------------------------------------------------------------------------------------


def body_sha256(body: Column | str) -> Column:
    return F.when(F.octet_length(col(body)) > 0, F.sha2(col(body).cast("binary"), 256))


def content_length(body: Column | str) -> Column:
    return F.when(F.octet_length(col(body)) > 0, F.octet_length(col(body)))


def capped_body(body: Column | str, most: int = 2 << 20) -> Column:
    """struct(body, truncated): at most `most` bytes."""
    b = col(body).cast("binary")
    return F.struct(F.substring(b, 1, most).alias("body"), (F.octet_length(b) > most).alias("truncated"))


def sanitized(text: Column | str) -> Column:
    """Without control characters, but for tab and line ends."""
    return F.regexp_replace(col(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncated_utf8(text: Column | str, most: int, suffix: str = "...") -> Column:
    """At most `most` bytes, the suffix included, without cutting a character."""
    t = col(text)
    room = max(0, most - len(suffix.encode()))
    raw = F.substring(t.cast("binary"), 1, room + 1)
    # a character begun within the room but not ended there goes: drop its lead and continuation bytes
    cut = F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"(?s)(?:[À-ÿ][\u0080-¿]*|.)$", "")
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"), F.lit(suffix)))


def version_text(v: Column | str) -> Column:
    """A version without blanks around it; null if empty or a hash (7 or more hex digits)."""
    t = F.trim(col(v))
    return F.when((t != "") & ~t.rlike(r"^[0-9a-fA-F]{7,}\z"), t)


# --- tokens -----------------------------------------------------------------------------------------------------------


def base64url(text: Column | str) -> Column:
    """Decoded bytes as text, null where it is no base64url, padded or not."""
    t = F.regexp_replace(F.translate(col(text), "-_", "+/"), "=+$", "")
    padded = F.concat(t, F.element_at(F.array(F.lit(""), F.lit(None).cast("string"), F.lit("=="), F.lit("=")), (F.length(t) % 4 + 1).cast("int")))
    fine = t.rlike(r"^[A-Za-z0-9+/]*\z")
    return F.when(fine, F.try_to_binary(padded, F.lit("base64")).cast("string"))


def claim_ms(json: Column, name: str) -> Column:
    """A claim in seconds as milliseconds, fractions cut, held within a long."""
    v = F.get_json_object(json, f"$.{name}").try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.least(F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double") * 1000.0, F.lit(9.2e18)), F.lit(-9.2e18)).cast("long"))


def jwt(token: Column | str) -> Column:
    """struct of a token's header, payload and claims; null unless it has three parts and both decode to JSON objects."""
    parts = F.split(F.regexp_replace(F.trim(col(token)), r"\\+$", ""), r"\.")
    header, payload = base64url(F.get(parts, F.lit(0))), base64url(F.get(parts, F.lit(1)))
    fine = (F.size(parts) == 3) & F.ltrim(header).startswith("{") & F.ltrim(payload).startswith("{") & F.try_parse_json(header).isNotNull() & F.try_parse_json(payload).isNotNull()
    head, claim = (lambda n: F.get_json_object(header, f"$.{n}")), (lambda n: F.get_json_object(payload, f"$.{n}"))
    fields = [header.alias("header_json"), payload.alias("payload_json"), head("alg").alias("algorithm"), head("typ").alias("token_type"), claim("iss").alias("issuer"), claim("sub").alias("subject"), claim("aud").alias("audience"), claim_ms(payload, "exp").alias("expiration_ms"), claim_ms(payload, "iat").alias("issued_at_ms"), claim_ms(payload, "nbf").alias("not_before_ms"), claim("jti").alias("jwt_id")]
    return F.when(fine, F.struct(*fields))


def wrapped_jwt(token: Column | str) -> Column:
    """A token that is itself base64url, or else a plain one."""
    return F.coalesce(jwt(base64url(token)), jwt(token))


# --- WHOIS ------------------------------------------------------------------------------------------------------------

WHOIS_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]


def whois_ms(text: Column | str) -> Column:
    """A WHOIS date as epoch milliseconds, by the first format that fits; the epoch itself counts as none."""
    t = F.trim(col(text))
    parsed = F.coalesce(*[F.unix_millis(F.try_to_timestamp(t if "X" in f else F.concat(t, F.lit(" +00:00")), F.lit(f if "X" in f else f + " XXX"))) for f in WHOIS_FORMATS])
    return F.nullif(parsed, F.lit(0).cast("long"))


def whois_field(raw: Column | str, *labels: str) -> Column:
    """The first non-empty value of a line that begins with one of the labels, in any case."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(col(raw), rf"(?im)^[ \t]*{label}[ \t]*:[ \t]*(\S[^\r\n]*)$", 1)), F.lit("")) for label in labels])


# --- certificates and labels ------------------------------------------------------------------------------------------

#: Object identifiers of key algorithms, and error types by status; fixed values.
KEY_ALGORITHMS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECDSA", "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448"}
TLS_VERSIONS = ["TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3", "SSLv3"]
STATUS_TEXT = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


def by_map(x: Column | str, mapping: dict, otherwise=None) -> Column:
    out = F.lit(otherwise).cast("string")
    for k, v in mapping.items():
        out = F.when(col(x) == k, v).otherwise(out)
    return out


def key_algorithm(oid: Column | str) -> Column:
    return F.coalesce(by_map(oid, KEY_ALGORITHMS), col(oid))


def tls_label(v: Column | str) -> Column:
    return F.when(col(v).isin(TLS_VERSIONS), col(v)).when(col(v).isNotNull(), "Unknown")


def status_text(status: Column | str) -> Column:
    return by_map(status, STATUS_TEXT, "Unknown Status Code")


def cert_flags(subject: Column | str, issuer: Column | str, sans: Column | str, host: Column | str) -> Column:
    """struct(self_signed, wildcard, mismatched); a wildcard name stands for one label before its base, or the base alone."""
    h, names = F.lower(col(host)), F.transform(F.coalesce(col(sans), F.array().cast("array<string>")), F.lower)
    common = F.lower(F.regexp_extract(col(subject), r"(?i)(?:^|[,/]\s*)CN\s*=\s*([^,/]+)", 1))
    base = F.regexp_replace(h, r"^[^.]+\.", "")
    fits = lambda n: (n == h) | (n.startswith("*.") & ((F.substring(n, F.lit(3), F.length(n)) == base) | (F.substring(n, F.lit(3), F.length(n)) == h)))
    return F.struct((col(subject) == col(issuer)).alias("self_signed"), F.exists(names, lambda n: n.startswith("*.")).alias("wildcard"), (~F.exists(names, fits) & ~fits(F.trim(common))).alias("mismatched"))


#: Error types of statuses; fixed values.
STATUS_ERRORS = {400: "Bad Request (400)", 401: "Unauthorized (401)", 403: "Bot detection (403 Forbidden)", 404: "Not Found (404)", 429: "Too many requests", 500: "Internal Server Error (500)", 502: "Bad Gateway (502)", 503: "Service Unavailable (503)", 504: "Gateway Timeout (504)"}
OTHER_ERROR = "HTTP request other error"


def status_error(status: Column | str) -> Column:
    return F.coalesce(by_map(status, STATUS_ERRORS), F.when(col(status).between(400, 599), OTHER_ERROR))


#: For each kind of failure, in the order in which they are tried, the groups of words of which one each must occur; fixed values.
MESSAGE_ERRORS = [
    ("HTTP request timeout error", ("request timeout",)), ("HTTP request timeout error", ("http",), ("timeout",)), ("Process URL timeout", ("timeout",)),
    ("DNS TXT lookup error", ("dns", "resolve", "lookup failed"), ("txt",)), ("DNS MX lookup error", ("dns", "resolve", "lookup failed"), ("mx", "mail")), ("DNS NS lookup error", ("dns", "resolve", "lookup failed")),
    ("TLS certificate error", ("tls", "ssl", "certificate", "handshake")),
]


def message_error(message: Column | str) -> Column:
    """The error type that a message's words point to; the first kind that fits wins."""
    m, out = F.lower(col(message)), F.lit(OTHER_ERROR)
    for kind, *groups in reversed(MESSAGE_ERRORS):
        fits = F.lit(True)
        for words in groups:
            fits = fits & m.rlike("|".join(words))
        out = F.when(fits, kind).otherwise(out)
    return out


def retriable(status: Column | str, error_type: Column | str) -> Column:
    s, e = col(status), F.lower(F.coalesce(col(error_type), F.lit("")))
    by_type = F.contains(e, F.lit("timeout")) | F.contains(e, F.lit("connect")) | F.contains(e, F.lit("request error")) | F.contains(e, F.lit("dns"))
    return F.when(s.isNotNull(), (s == 429) | s.between(500, 599)).otherwise(by_type)


def severity_rank(severity: Column | str) -> Column:
    s = col(severity)
    return F.when(s == "critical", 1).when(s == "high", 2).when(s == "medium", 3).when(s == "low", 4)


def shannon_entropy(text: Column | str) -> Column:
    """Bits a character, from the counts of a text's characters."""
    chars = F.filter(F.split(col(text), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n)
    return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def exit_code(policy: str, total: int, failed: int, percent: float = 0.0) -> int:
    """0 fine, 2 too many failures, 3 nothing was scanned."""
    if policy == "never":
        return 0
    if total == 0:
        return 3
    return 2 if (failed if policy == "any" else 100.0 * failed / total > percent) else 0
