import base64
import json
import random
from urllib.parse import unquote_to_bytes, urljoin

from pyspark.sql import functions as F

from webstrata.functions import domains as D
from webstrata.functions import scalar as S
from webstrata.functions.html import parse
from webstrata.operators import extract as X
from webstrata.operators import geo


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'map<string,string>' if isinstance(v, dict) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x string")
    return df.select(column.alias("out")).first()["out"]


def test_time_and_urls(spark):
    assert one(spark, S.epoch_text("a"), a=1704067205123) == "2024-01-01 00:00:05"
    assert one(spark, S.epoch_text("a"), a=-1) == "1969-12-31 23:59:59"
    assert one(spark, S.epoch_date("a"), a=1704067205123) == "2024-01-01"
    assert one(spark, S.micros_to_millis("a"), a=1499) == 1 and one(spark, S.micros_to_millis("a"), a=1500) == 2
    assert one(spark, S.normalized_url("a"), a="example.com/x") == "https://example.com/x"
    assert one(spark, S.normalized_url("a"), a="ftp://example.com") is None and one(spark, S.normalized_url("a"), a="x" * 3000) is None
    for url, ok in (("https://example.com", True), ("http://localhost/", False), ("http://127.0.0.1/", False), ("http://10.1.2.3/", False), ("http://172.32.0.1/", True), ("http://198.19.255.255/", False), ("http://[::1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://8.8.8.8/", True), ("ftp://example.com", False), ("http://[::ffff:7f00:1]/", False), ("http://[0:0::1]/", False), ("http://[0:0:0:0:0:0:0:1]:8080/x", False), ("http://[fd00::1]/", False), ("http://[2606:4700::1111]/", True), ("http://[::ffff:8.8.8.8]/", True), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://127.1/", False), ("http://localhost./", False)):
        assert one(spark, S.allowed_target("a"), a=url) is ok, url


def test_domains(spark):
    for host, want in (("www.example.com", "example.com"), ("a.b.example.co.uk", "example.co.uk"), ("co.uk", None), ("192.0.2.1", "192.0.2.1"), ("localhost", None), ("x.github.io", "x.github.io"), ("EXAMPLE.org.", "example.org"), ("foo.co.at", "foo.co.at"), ("a.foo.com.pl", "foo.com.pl"), ("x.y.ck", "x.y.ck"), ("y.ck", None), ("a.www.ck", "www.ck"), ("a.city.kobe.jp", "city.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"), ("a.nosuchsuffix", "a.nosuchsuffix"), ("a.食狮.公司.cn", "食狮.公司.cn"), ("www.xn--55qx5d.cn", "www.xn--55qx5d.cn"), ("a..com", None), (".com", None), ("com", None)):
        assert one(spark, D.registrable("a"), a=host) == want, host
    assert one(spark, D.root_domain("a"), a="co.uk") == "co.uk"
    assert one(spark, D.percent_decoded("a"), a="a%41%zz+%ff") == "aA%zz+�"


def test_suffix_list_is_package_data(spark, monkeypatch):
    """No other package's files are needed, and a column holds in sessions other than the one it was built in."""
    import zipfile

    def hidden(*_, **__):
        raise FileNotFoundError("no jars here")

    monkeypatch.setattr(zipfile, "ZipFile", hidden)
    monkeypatch.setattr("glob.glob", hidden)
    D.public_suffixes.cache_clear()
    D.trie.cache_clear()
    column = D.registrable("host")
    other = spark.newSession()
    assert [r[0] for r in other.createDataFrame([("a.b.co.uk",), (None,), ("x.co.uk",)], "host string").select(column).collect()] == ["b.co.uk", None, "x.co.uk"]
    assert len(D.public_suffixes()) > 9000


def slow_suffix(rules, labels):
    """The list's rule read literally: every rule against every tail."""
    best = 1
    for n in range(1, len(labels) + 1):
        tail = ".".join(labels[-n:])
        if "!" + tail in rules:
            return n - 1
        if tail in rules or "*." + ".".join(labels[-n:][1:]) in rules and n > 1:
            best = max(best, n)
    return best


def test_trie_against_every_rule():
    rng = random.Random(5)
    for _ in range(40):
        names = {".".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(8)}
        rules = tuple(sorted(names | {"*." + n for n in rng.sample(sorted(names), 2)} | {"!a." + n for n in rng.sample(sorted(names), 1)}))
        own = D.SuffixTrie(rules)
        for _ in range(60):
            labels = rng.choices("abcd", k=rng.randint(1, 5))
            tails = [".".join(labels[-n:]) for n in range(1, len(labels) + 1)]
            if sum("!" + t in rules for t in tails) <= 1:
                assert own.size(labels) == slow_suffix(set(rules), labels), (rules, labels)
    try:
        D.SuffixTrie(("a.*.b",))
    except ValueError:
        return
    raise AssertionError("a wildcard inside a rule is refused")


def test_url_join(spark):
    """The examples of RFC 3986, 5.4, and what must give nothing."""
    base = "http://a/b/c/d;p?q"
    normal = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "g;x?y#s": "http://a/b/c/g;x?y#s", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g", " g ": "http://a/b/c/g", "HTTPS://h.com/x": "https://h.com/x"}
    nothing = ["", "  ", "data:x", "mailto:a@b.c", "javascript:f()", "ftp://h/x", "https://", None]
    got = {r.ref: r.out for r in spark.createDataFrame([(x,) for x in [*normal, *nothing]], "ref string").select("ref", D.url_join(F.lit(base), "ref").alias("out")).collect()}
    assert {k: got[k] for k in normal} == normal and all(got[x] is None for x in nothing)
    plain = ["d.js", "//cdn.net/x", "/a/b.js?v=1", "../x.png", "x?a=b:c", "a/b/../c"]
    for page in ("https://a.com/b/c", "https://a.com", "https://a.com/b/?q=/x/", "http://u@h.org:8080/p/"):
        rows = spark.createDataFrame([(x,) for x in plain], "ref string").select("ref", D.url_join(F.lit(page), "ref").alias("out")).collect()
        assert {r.ref: r.out for r in rows} == {x: urljoin(page, x) for x in plain}, page


def test_percent_decoding(spark):
    texts = ["plain", "a+b", "%", "%4", "%zz%41", "%C3%A9", "%e2%82%ac 100%", "x%ffy", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", D.percent_decoded("t").alias("out")).collect()
    assert {r.t: r.out for r in rows} == {x: None if x is None else unquote_to_bytes(x).decode("utf-8", "replace") for x in texts}


def test_dns_and_headers(spark):
    assert one(spark, S.first_spf("a"), a=["x", " v=spf1 -all", "v=spf1 b"]) == " v=spf1 -all"
    assert [one(spark, S.txt_kind("a"), a=t) for t in ("V=SPF1 x", "v=DMARC1", "google-site-verification=1", "z")] == ["SPF", "DMARC", "VERIFICATION", "OTHER"]
    assert tuple(one(spark, S.mx_entry("a"), a="10 mx.example.com")) == (10, "mx.example.com") and tuple(one(spark, S.mx_entry("a"), a="mx.example.com")) == (0, "mx.example.com")
    assert one(spark, S.mx_entry("a"), a="10") is None and tuple(one(spark, S.mx_entry("a"), a='{"priority": 5, "exchange": "m"}')) == (5, "m")
    for text, want in (('{"priority": 7, "hostname": "m"}', (7, "m")), ("junk host", (0, "junk")), ("-5 mx", (-5, "mx")), ("+5 mx", (5, "mx")), ("  10   mx  more", (10, "mx")), ("99999999999 x", (0, "99999999999"))):
        assert tuple(one(spark, S.mx_entry("a"), a=text)) == want, text
    for text, want in (('[{"priority": 10, "hostname": "a"}, {"priority": 20}, {"priority": 5, "hostname": "b"}]', [(10, "a"), (5, "b")]), ('["10 a", "b", "7", ""]', [(10, "a"), (0, "b")]), ("[]", None), ("{", None), ('[{"x": 1}]', None), ("", None)):
        got = one(spark, S.mx_entries("a"), a=text)
        assert (None if got is None else [tuple(x) for x in got]) == want, text
    assert one(spark, S.json_strings("a"), a='["x","y"]') == ["x", "y"] and one(spark, S.json_strings("a"), a="{") is None
    assert tuple(one(spark, S.hsts("a"), a="max-age=31536000; includeSubDomains; preload")) == (31536000, True, True)
    assert [tuple(x) for x in one(spark, S.csp_domains("a"), a="default-src 'self' https://A.Example.com:443 *.cdn.net; script-src a.example.com a.example.com")] == [("default-src", "a.example.com"), ("default-src", "cdn.net"), ("script-src", "a.example.com")]
    assert tuple(one(spark, S.cookie("a"), a="sid=1; Path=/x; HttpOnly; SameSite=Lax; Domain=Ex.com; Secure")) == ("sid", True, True, "lax", "Ex.com", "/x")
    got = one(spark, S.header_rows("a", S.SECURITY_HEADERS), a={"x-frame-options": "DENY", "Other": "1"})
    assert [tuple(x) for x in got] == [("X-Frame-Options", "DENY")]


def test_bodies(spark):
    assert one(spark, S.body_sha256("a"), a="") is None and one(spark, S.content_length("a"), a="é") == 2
    assert one(spark, S.sanitized("a"), a="a\x00b\tc\x7fd\x1f") == "ab\tc\x7fd"
    for text in ("ééééé", "abcdefgh", "aé日本語x", "short"):
        cut = one(spark, S.truncated_utf8("a", 8), a=text)
        assert len(cut.encode()) <= 8 and (cut == text or cut.endswith("..."))
    assert one(spark, S.version_text("a"), a=" 1.2 ") == "1.2" and one(spark, S.version_text("a"), a="deadbeef1") is None
    assert abs(one(spark, S.shannon_entropy("a"), a="aabb") - 1.0) < 1e-9


def token(claims, head=None):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{enc(head or {'alg': 'HS256', 'typ': 'JWT'})}.{enc(claims)}.c2ln"


def test_tokens(spark):
    got = one(spark, S.jwt("a"), a=token({"iss": "me", "aud": ["x", "y"], "exp": 10, "iat": 1.9}) + "\\")
    assert (got.algorithm, got.token_type, got.issuer, got.expiration_ms, got.issued_at_ms, json.loads(got.audience)) == ("HS256", "JWT", "me", 10_000, 1000, ["x", "y"])
    assert one(spark, S.jwt("a"), a="a.b") is None and one(spark, S.jwt("a"), a="!!.b.c") is None
    assert one(spark, S.wrapped_jwt("a"), a=base64.urlsafe_b64encode(token({"sub": "s"}).encode()).decode()).subject == "s"


def test_whois_and_labels(spark):
    assert one(spark, S.whois_ms("a"), a="2024-01-02T03:04:05Z") == 1704164645000 and one(spark, S.whois_ms("a"), a="02-Jan-2024") == 1704153600000
    assert one(spark, S.whois_ms("a"), a="1970-01-01") is None and one(spark, S.whois_ms("a"), a="soon") is None
    assert one(spark, S.whois_field("a", "Registrant Country", "Country"), a="x\n country: DE \n") == "DE"
    assert one(spark, S.key_algorithm("a"), a="1.3.101.112") == "Ed25519" and one(spark, S.status_error("a"), a=404) == "Not Found (404)"
    assert [one(spark, S.message_error("a"), a=m) for m in ("DNS TXT failed", "http timeout", "timeout", "tls x", "?")] == ["DNS TXT lookup error", "HTTP request timeout error", "Process URL timeout", "TLS certificate error", "HTTP request other error"]
    got = spark.createDataFrame([("CN=a.com", "CN=b", ["*.example.com"], "x.example.com"), ("CN=a.com", "CN=a.com", ["*.example.com"], "x.y.example.com"), ("CN=a.com, O=x", "i", None, "a.com")], "s string, i string, n array<string>, h string").select(S.cert_flags("s", "i", "n", "h").alias("f")).collect()
    assert [tuple(r.f) for r in got] == [(False, True, False), (True, True, True), (False, False, False)]
    assert S.exit_code("any", 5, 1) == 2 and S.exit_code("pct", 0, 0) == 3 and S.exit_code("pct", 10, 1, 10.0) == 0


HTML = """<html><head><title> A &amp; B </title><title>no</title><meta name="Description" content="x"><meta name="description" content=" d "><meta property="og:title" content="1"><meta property="og:title" content="2"><meta name="twitter:card" content="s">
<meta http-equiv="refresh" content="5; url='/next'"><link rel="canonical" href="/c"><link rel="preconnect" href="https://Fonts.Example.com/x"><link rel="dns-prefetch" href="//local"><link rel="shortcut icon" href="/f.ico">
<script id="S1" src="/a.js"></script><script>var t="</p>"; GO()</script><script type="application/ld+json">[{"@type": "Org"}, {"@type": ["A", "B"]}]</script><script>{"x":1}</script></head><body><a href="mailto:A%40b.c?x">m</a><a href="tel:1">t</a>"""


def test_page(spark):
    p = parse(HTML)
    assert (p["title"], p["description"], p["canonical_url"], p["favicon_href"], p["script_sources"], p["script_ids"], p["inline_script"]) == ("A & B", "d", "/c", "/f.ico", ["/a.js"], ["S1"], 'var t="</p>"; go()')
    assert p["hints"] == [{"hint_type": "preconnect", "href": "fonts.example.com"}]
    assert parse(None)["title"] == "" and parse("<title>x")["title"] == "x"
    rows = X.parsed(spark.createDataFrame([(1, "https://www.example.com/d/", HTML)], "id long, url string, html string"))
    r = rows.first()
    assert r.meta_refresh_url == "/next"
    got = {tuple(x) for x in X.structured_data(rows, "id").collect()}
    assert got == {(1, "json_ld", "", '{"@type":"Org"}'), (1, "json_ld", "", '{"@type":["A","B"]}'), (1, "open_graph", "og:title", "2"), (1, "twitter_card", "twitter:card", "s"), (1, "schema_type", "Org", ""), (1, "schema_type", "A", ""), (1, "schema_type", "B", "")}
    assert {tuple(x) for x in X.contact_links(rows, "id").select("contact_type", "contact_value").collect()} == {("email", "A@b.c"), ("phone", "1")}
    assert [tuple(x) for x in X.script_hosts(rows, "id").collect()] == [(1, "www.example.com", "example.com", True)]


def test_social_first_pattern_wins(spark):
    got = one(spark, X.social("a"), a=["https://x.com/u?q", "https://x.com/u?q", "//twitter.com/v", "/relative", "https://www.youtube.com/c/z"])
    assert [tuple(x) for x in got] == [("Twitter", "https://x.com/u?q", "u"), ("YouTube", "https://www.youtube.com/c/z", "z")]


def test_longest_prefix(spark):
    nets = geo.networks(spark.createDataFrame([("10.0.0.0/8", "big"), ("10.1.0.0/16", "small"), ("0.0.0.0/0", "all")], "network string, name string"))
    got = geo.locate(spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",), ("9.9.9.9",), ("x",), ("10.1.2.3",)], "ip_address string"), nets).select("ip_address", "name").collect()
    assert sorted((r.ip_address, r.name or "") for r in got) == [("10.1.2.3", "small"), ("10.1.2.3", "small"), ("10.2.0.1", "big"), ("9.9.9.9", "all"), ("x", "")]


def test_native_json_ld(spark):
    assert one(spark, F.size(X.native_json_ld("a")), a=HTML) == 2


def test_icons_and_charsets(spark):
    from webstrata.functions import binary as B

    assert B.murmur3(b"hello") == 613153351 and B.murmur3(b"") == 0 and B.murmur3(b"test", 0) == -1167338989
    assert B.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and B.decoded(b"\xef\xbb\xbfx", None) == "x"
    assert B.decoded(b'<meta charset="utf-16-le">', "") is not None and B.decoded(b"\xff", None) == "\ufffd" and B.decoded(b"a", "text/html; charset=none-such") == "a"
    df = spark.createDataFrame([(bytearray(b"icon"), "text/html", "https://e.com/a/b", "i.png"), (None, None, "https://e.com/a/b", None)], "d binary, k string, p string, h string")
    got = df.select(B.favicon_hash("d").alias("f"), B.decode_body("d", "k").alias("t"), B.favicon_url("p", "h").alias("u")).collect()
    assert [tuple(r) for r in got] == [(B.icon_hash(b"icon"), "icon", "https://e.com/a/i.png"), (None, None, "https://e.com/favicon.ico")]


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = b""
    for n in [40 * first + second, *rest]:
        digits = [n & 0x7F]
        while n := n >> 7:
            digits.append(n & 0x7F | 0x80)
        out += bytes(reversed(digits))
    return der(0x06, out)


def test_certificate_names(spark):
    from webstrata.functions.certificates import certificate_names

    sans = der(0x30, *[der(0x82, f"h{i}.example.com".encode()) for i in range(20)], der(0x82, b"h1.example.com"), der(0x87, b"\x01\x02\x03\x04"))
    extensions = [
        der(0x30, oid("2.5.29.17"), der(0x04, sans)), der(0x30, oid("2.5.29.19"), der(0x01, b"\xff"), der(0x04, der(0x30))),
        der(0x30, oid("2.5.29.37"), der(0x04, der(0x30, oid("1.3.6.1.5.5.7.3.1")))), der(0x30, oid("2.5.29.32"), der(0x04, der(0x30, der(0x30, oid("2.23.140.1.2.1"), der(0x30))))),
    ]
    body = der(0x30, der(0xA0, der(0x02, b"\x02")), der(0x02, b"\x05"), der(0x30, oid("1.2.840.113549.1.1.11")), der(0xA3, der(0x30, *extensions)))
    cert = der(0x30, body, der(0x30, oid("1.2.840.113549.1.1.11")), der(0x03, b"\x00sig"))
    rows = spark.createDataFrame([(1, cert), (2, cert[:-3]), (3, b""), (4, None), (5, b"junk")], "id long, der binary")
    got = {r.id: r.c for r in rows.select("id", certificate_names("der").alias("c")).collect()}
    assert got[1].sans == [f"h{i}.example.com" for i in range(20)]
    assert got[1].oids == sorted(["2.5.29.17", "2.5.29.19", "2.5.29.37", "2.5.29.32", "1.3.6.1.5.5.7.3.1", "2.23.140.1.2.1"])
    assert all(got[i].sans == [] and got[i].oids == [] for i in (2, 3, 4, 5))
