"""Queries over page captures: native extraction, held against SQL. Pages of the driver's tables lack most markup, so both
sides append the same deterministic markup, built from page_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalar as S
from webstrata.operators import extract as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Markup with %d for page_id; {{ and }} don't occur.
MARKUP = """<script>ga('create', 'UA-%d-1'); gtag('config','G-AB%d'); fbq('init', '99%d'); var dataLayer="GTM-ABC%dX"</script><script src="https://cdn%d.example.net/a.js"></script><a href="https://twitter.com/u%d?x=1">t</a><a href='https://github.com/g%d/r'>g</a><a href="mailto:m%d@example.org?subject=x">m</a><a href="tel:+1555%d">p</a><meta content="ca-pub-1234567890%d">"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = MARKUP.split("%d")
    parts = [F.col("html")]
    for i, bit in enumerate(bits):
        parts += [F.lit(bit)] + ([F.col("page_id").cast("string")] if i + 1 < len(bits) else [])
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", F.concat(*parts).alias("page"))


MARKED = "SELECT page_id, url, html, concat(html, " + ", page_id, ".join("'" + b.replace("'", "''") + "'" for b in MARKUP.split("%d")) + ") AS page FROM pages"


def query(name: str, sql: str):
    def add(plan):
        QUERIES[name], SQL[name] = lambda spark, sf_dir: plan(marked(spark, sf_dir)), f"WITH marked AS ({MARKED}) {sql}"
        return plan

    return add


@query("page_observations", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, sha256(html) AS body_sha256, strlen(html) AS content_length, url LIKE 'https://%' AS is_https FROM marked")
def _(p):
    return p.select("page_id", S.url_host("url").alias("host"), X.native_title("html").alias("title"), S.body_sha256("html").alias("body_sha256"), S.content_length("html").alias("content_length"), F.col("url").startswith("https://").alias("is_https"))


@query("page_hosts", r"SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages, sum(strlen(html))::BIGINT AS bytes, count(DISTINCT sha256(html)) AS bodies FROM marked GROUP BY 1")
def _(p):
    return p.groupBy(S.url_host("url").alias("host")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.count_distinct(S.body_sha256("html")).alias("bodies"))


@query("page_links", r"""SELECT page_id, unnest(regexp_extract_all(page, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'i')) AS href FROM marked""")
def _(p):
    return p.select("page_id", F.explode(X.native_hrefs("page")).alias("href"))


@query("page_scripts", r"SELECT DISTINCT page_id, unnest(regexp_extract_all(page, '<script[^>]*src\s*=\s*[" + "\"" + r"'']([^" + "\"" + r"'']+)[" + "\"" + r"'']', 1, 'i')) AS src FROM marked")
def _(p):
    return p.select("page_id", F.explode(X.native_script_sources("page")).alias("src"))


ANALYTICS_SQL = " UNION ".join(
    f"SELECT page_id, '{provider}' AS provider, {'concat(' + chr(39) + 'pub-' + chr(39) + ', x)' if provider == 'Google AdSense' else 'x'} AS tracking_id FROM (SELECT page_id, unnest(regexp_extract_all(page, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', 1{', ' + chr(39) + 'i' + chr(39) if pattern.startswith('(?i)') else ''})) AS x FROM marked)"
    for provider, pattern in X.ANALYTICS
)


@query("page_analytics", ANALYTICS_SQL)
def _(p):
    return X.satellite(p, "page_id", X.analytics("page"))


@query("page_social", r"""SELECT DISTINCT page_id, CASE WHEN href LIKE '%twitter.com%' THEN 'Twitter' ELSE 'GitHub' END AS platform, href AS profile_url, regexp_extract(href, 'https?://(?:www\.)?(?:twitter|github)\.com/([^/?#]+)', 1) AS identifier FROM (SELECT page_id, unnest(regexp_extract_all(page, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'i')) AS href FROM marked) WHERE regexp_matches(href, 'https?://(?:www\.)?(?:twitter|github)\.com/')""")
def _(p):
    return X.satellite(p.select("page_id", X.native_hrefs("page").alias("hrefs")), "page_id", X.social("hrefs"))


@query("page_contacts", r"""SELECT page_id, CASE WHEN href LIKE 'mailto:%' THEN 'email' ELSE 'phone' END AS contact_type, trim(split_part(regexp_replace(href, '^(mailto|tel):', ''), '?', 1)) AS value, href AS raw_href FROM (SELECT page_id, unnest(regexp_extract_all(page, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'i')) AS href FROM marked) WHERE href LIKE 'mailto:%' OR href LIKE 'tel:%'""")
def _(p):
    return X.satellite(p.select("page_id", X.native_hrefs("page").alias("hrefs")), "page_id", X.contacts("hrefs"))


#: More markup for the parser, with %d for page_id.
HEAD = """<meta name="robots" content="noindex,p%d"><meta http-equiv="refresh" content="5; URL='/next%d'"><link rel="canonical" href=" /c%d "><link rel="preconnect" href="https://H%d.example.net/x"><link rel="dns-prefetch" href="//nodots"><link rel="preload" href="/a%d.js"><link rel="shortcut icon" href="/i%d.png"><meta property="og:title" content="first"><meta property="og:title" content="T%d"><meta name="twitter:card" content="c%d"><script type="application/ld+json">{"@type":"Org%d","n":%d}</script><script type="application/ld+json">[{"@type":["A","B%d"]}]</script><script type="application/ld+json">{broken</script><script id="s%d">var Inline=%d;</script><script type="application/json">{"a":1}</script><meta name="description" content=" D%d &amp; more "><a href="mailto:m%%2B%d%%40x.org?subject=y">m</a><a href="tel:+49%d">t</a>"""
PROFILES = [("LinkedIn", "https://www.linkedin.com/in/l%d"), ("Twitter", "https://x.com/t%d"), ("Facebook", "http://facebook.com/f%d/about"), ("Instagram", "https://instagram.com/i%d?x"), ("YouTube", "https://www.youtube.com/channel/y%d"), ("GitHub", "https://github.com/g%d"), ("TikTok", "https://tiktok.com/@k%d"), ("Pinterest", "https://pinterest.co.uk/p%d"), ("Snapchat", "https://snapchat.com/add/s%d"), ("Reddit", "https://reddit.com/r/r%d#top")]


def filled(text: str):
    """A text with page_id put in for each %d."""
    bits = text.replace("%%", "\x00").split("%d")
    parts = [F.lit(bits[0].replace("\x00", "%"))]
    for bit in bits[1:]:
        parts += [F.col("page_id").cast("string"), F.lit(bit.replace("\x00", "%"))]
    return F.concat(*parts)


def described(p: DataFrame) -> DataFrame:
    links = F.concat(*[filled(f'<a href="{url}">{name}</a>') for name, url in PROFILES])
    return X.parsed(p.select("page_id", "url", F.concat("html", filled(HEAD), F.when(F.col("page_id") % 2 == 0, links).otherwise("")).alias("html")))


@query("page_meta", "SELECT page_id, 'noindex,p' || page_id AS robots, '/next' || page_id AS refresh, '/c' || page_id AS canonical, '/i' || page_id || '.png' AS icon, 's' || page_id AS script_id, 'var inline=' || page_id || ';' AS inline_script, 'D' || page_id || ' & more' AS description FROM marked")
def _(p):
    return described(p).select("page_id", F.col("meta_robots").alias("robots"), F.col("meta_refresh_url").alias("refresh"), F.trim("p.canonical_url").alias("canonical"), F.col("p.favicon_href").alias("icon"), F.element_at("p.script_ids", -1).alias("script_id"), F.element_at(F.split("p.inline_script", "\n"), -1).alias("inline_script"), "description")


@query("page_hints", "SELECT page_id, unnest([{'hint_type': 'preconnect', 'href': 'h' || page_id || '.example.net'}, {'hint_type': 'preload', 'href': '/a' || page_id || '.js'}], recursive := true) FROM marked")
def _(p):
    return X.satellite(described(p), "page_id", F.col("p.hints"))


@query("page_structured_data", """SELECT page_id, unnest([{'data_type': 'json_ld', 'property_name': '', 'property_value': '{"@type":"Org' || page_id || '","n":' || page_id || '}'}, {'data_type': 'json_ld', 'property_name': '', 'property_value': '{"@type":["A","B' || page_id || '"]}'}, {'data_type': 'open_graph', 'property_name': 'og:title', 'property_value': 'T' || page_id},
{'data_type': 'twitter_card', 'property_name': 'twitter:card', 'property_value': 'c' || page_id}, {'data_type': 'schema_type', 'property_name': 'Org' || page_id, 'property_value': ''}, {'data_type': 'schema_type', 'property_name': 'A', 'property_value': ''}, {'data_type': 'schema_type', 'property_name': 'B' || page_id, 'property_value': ''}], recursive := true) FROM marked""")
def _(p):
    return X.structured_data(described(p), "page_id")


@query("page_profiles", "SELECT page_id, platform, href AS profile_url, identifier || page_id AS identifier FROM (SELECT page_id, platform, replace(pattern, '%d', page_id::VARCHAR) AS href, identifier FROM marked, (VALUES " + ", ".join(f"('{name}', '{url}', '{url.split('%d')[0].split('/')[-1].removeprefix('@')}')" for name, url in PROFILES) + ") v(platform, pattern, identifier) WHERE page_id % 2 = 0)")
def _(p):
    return X.satellite(described(p), "page_id", X.social("p.hrefs"))


@query("page_contact_links", "SELECT page_id, 'email' AS contact_type, 'm+' || page_id || '@x.org' AS contact_value, 'mailto:m%2B' || page_id || '%40x.org?subject=y' AS raw_href FROM marked UNION ALL SELECT page_id, 'phone', '+49' || page_id, 'tel:+49' || page_id FROM marked")
def _(p):
    return X.contact_links(described(p), "page_id")
