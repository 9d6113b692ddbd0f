"""Extraction: page captures to observations and their satellites.

The parser runs once a page (functions.html); all else is built-in expressions on its parts or on the raw body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import scalar as S
from webstrata.functions.domains import first_party, percent_decoded, root_domain, url_join
from webstrata.functions.html import page_parts
from webstrata.functions.scalar import col

#: Providers of analytics identifiers with the patterns that find them, in order; fixed values.
ANALYTICS = [
    ("Google Analytics", r"""(?i)ga\s*\(\s*['"]create['"]\s*,\s*['"](UA-\d+-\d+)['"]"""),
    ("Google Analytics 4", r"""(?i)gtag\s*\(\s*['"]config['"]\s*,\s*['"](G-[A-Z0-9]+)['"]"""),
    ("Facebook Pixel", r"""(?i)fbq\s*\(\s*['"]init['"]\s*,\s*['"](\d+)['"]"""),
    ("Google Tag Manager", r"\b(GTM-[A-Z0-9]{4,})\b"),
    ("Google AdSense", r"(?i)(?:ca-)?pub-(\d{10,})"),
]
#: Platforms with the patterns of their profile addresses, in order; fixed values.
SOCIAL = [
    ("LinkedIn", r"https?://(?:www\.)?linkedin\.com/(?:company|in|pub)/([^/?#]+)"), ("Twitter", r"https?://(?:www\.)?(?:twitter\.com|x\.com)/([^/?#]+)"), ("Facebook", r"https?://(?:www\.)?facebook\.com/([^/?#]+)"),
    ("Instagram", r"https?://(?:www\.)?instagram\.com/([^/?#]+)"), ("YouTube", r"https?://(?:www\.)?youtube\.com/(?:channel|c|user)/([^/?#]+)"), ("GitHub", r"https?://(?:www\.)?github\.com/([^/?#]+)"),
    ("TikTok", r"https?://(?:www\.)?tiktok\.com/@([^/?#]+)"), ("Pinterest", r"https?://(?:www\.)?pinterest\.(?:com|co\.uk)/([^/?#]+)"), ("Snapchat", r"https?://(?:www\.)?snapchat\.com/add/([^/?#]+)"),
    ("Reddit", r"https?://(?:www\.)?reddit\.com/(?:r|u)/([^/?#]+)"),
]


def native_title(html: Column | str) -> Column:
    """The first title by pattern alone: no parser, entities stay."""
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def native_script_sources(html: Column | str) -> Column:
    # the pattern is a fixed value
    return F.array_distinct(F.regexp_extract_all(col(html), F.lit(r"""(?i)<script[^>]*src\s*=\s*["']([^"']+)["']"""), 1))


def native_hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)


def native_json_ld(html: Column | str) -> Column:
    """The JSON-LD blocks of a body that parse; arrays are flattened."""
    blocks = F.regexp_extract_all(col(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    return json_objects(blocks)


def json_objects(blocks: Column) -> Column:
    each = lambda b: F.when(F.trim(b).startswith("["), F.coalesce(F.transform(F.from_json(F.concat(F.lit('{"a":'), b, F.lit("}")), "a array<string>")["a"], lambda x: x), F.array().cast("array<string>"))).otherwise(F.array(F.trim(b)))
    return F.flatten(F.transform(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), each))


def schema_types(objects: Column) -> Column:
    """@type of each object, a string or a list, one entry each."""

    def of(o: Column) -> Column:
        t = F.get_json_object(o, "$['@type']")
        return F.when(t.isNull(), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(t))

    return F.flatten(F.transform(objects, of))


def analytics(html: Column | str) -> Column:
    """array<struct(provider, tracking_id)>, each pair once."""
    found = []
    for provider, pattern in ANALYTICS:
        ids = F.regexp_extract_all(col(html), F.lit(pattern), 1)
        if provider == "Google AdSense":
            ids = F.transform(ids, lambda x: F.concat(F.lit("pub-"), x))
        named = F.lit(provider).alias("provider")
        found.append(with_provider(ids, named))
    return F.array_distinct(F.concat(*found))


def with_provider(ids: Column, provider: Column) -> Column:
    return F.transform(ids, lambda x: F.struct(provider, x.alias("tracking_id")))


def social(hrefs: Column | str) -> Column:
    """array<struct(platform, profile_url, identifier)>, one for each distinct href that a pattern fits; the first pattern wins."""

    def of(h: Column) -> Column:
        out = F.lit(None).cast("struct<platform: string, profile_url: string, identifier: string>")
        url = F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(F.concat(F.lit("https://"), h))
        for platform, pattern in reversed(SOCIAL):
            out = F.when(h.rlike(pattern), F.struct(F.lit(platform).alias("platform"), url.alias("profile_url"), F.regexp_extract(h, pattern, 1).alias("identifier"))).otherwise(out)
        return F.when(~h.rlike("^/[^/]") | h.startswith("//"), out)

    return F.filter(F.transform(F.array_distinct(col(hrefs)), of), lambda s: s.isNotNull())


def contacts(hrefs: Column | str) -> Column:
    """array<struct(contact_type, value, raw_href)> of mailto: and tel: links; values are still percent-encoded."""

    def of(h: Column) -> Column:
        low = F.lower(h)
        value = F.trim(F.split(F.regexp_replace(h, "(?i)^(mailto|tel):", ""), r"\?")[0])
        return F.struct(F.when(low.startswith("mailto:"), "email").when(low.startswith("tel:"), "phone").alias("contact_type"), value.alias("value"), h.alias("raw_href"))

    return F.filter(F.transform(col(hrefs), of), lambda s: s["contact_type"].isNotNull() & (s["value"] != ""))


def meta_value(meta: Column | str, *keys: str) -> Column:
    """The first content of the first key that a page has."""
    pick = lambda k: F.get(F.filter(col(meta), lambda m: m["key"] == k), F.lit(0))["content"]
    return F.coalesce(*[pick(k) for k in keys])


def meta_refresh(meta: Column | str) -> Column:
    v = meta_value(meta, "http-equiv:refresh")
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(v, r"(?i)url\s*=(.*)$", 1)), r"""^['"]|['"]$""", "")), F.lit(""))


def last_of(meta: Column | str, prefix: str) -> Column:
    """array<struct(name, value)> of the keys with a prefix (as in property:og:), the last content of each."""
    some = F.filter(col(meta), lambda m: m["key"].startswith(prefix))
    names = F.array_distinct(F.transform(some, lambda m: m["key"]))
    return F.transform(names, lambda n: F.struct(F.regexp_replace(n, "^[^:]*:", "").alias("name"), F.element_at(F.filter(some, lambda m: m["key"] == n), -1)["content"].alias("value")))


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their parts and the facts of an observation. The domain is left to those who ask for it (root_domain of host)."""
    p = pages.withColumn("p", page_parts(F.col(html)))
    return p.select(
        *pages.columns, "p", S.url_host(url).alias("host"), F.col("p.title").alias("title"), F.nullif(F.col("p.description"), F.lit("")).alias("description"), F.nullif(F.trim("p.canonical_url"), F.lit("")).alias("canonical_url"),
        meta_value("p.meta", "name:robots").alias("meta_robots"), meta_refresh("p.meta").alias("meta_refresh_url"), S.body_sha256(html).alias("body_sha256"), S.content_length(html).alias("content_length"), (F.octet_length(html) > (2 << 20)).alias("body_truncated"),
    )


def satellite(rows: DataFrame, key: str, items: Column) -> DataFrame:
    """One row for each struct of an array column, with the key."""
    return rows.select(key, F.explode(items).alias("x")).select(key, "x.*")


def structured_data(rows: DataFrame, key: str) -> DataFrame:
    """(data_type, property_name, property_value) of JSON-LD, its types, Open Graph and Twitter cards."""
    row = lambda kind, name, value: F.struct(F.lit(kind).alias("data_type"), name.alias("property_name"), value.alias("property_value"))
    objects, blank = json_objects(F.col("p.json_ld")), F.lit("")
    parts = [
        F.transform(objects, lambda o: row("json_ld", blank, o)),
        F.transform(last_of("p.meta", "property:og:"), lambda s: row("open_graph", s["name"], s["value"])),
        F.transform(last_of("p.meta", "name:twitter:"), lambda s: row("twitter_card", s["name"], s["value"])),
        F.transform(schema_types(objects), lambda t: row("schema_type", t, blank)),
    ]
    return satellite(rows, key, F.array_distinct(F.concat(*parts)))


def contact_links(rows: DataFrame, key: str) -> DataFrame:
    links = satellite(rows, key, contacts("p.hrefs")).withColumn("contact_value", percent_decoded("value"))
    return links.groupBy(key, "contact_type", "contact_value").agg(F.max("raw_href").alias("raw_href"))


def script_hosts(rows: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(host, registrable_domain, is_first_party) of the scripts' hosts, each once."""
    src = rows.select(key, "host", F.col(url).alias("page"), F.explode("p.script_sources").alias("src"))
    hosts = src.select(key, F.col("host").alias("page_host"), S.url_host(url_join("page", "src")).alias("script_host")).where("script_host IS NOT NULL").distinct()
    return hosts.select(key, F.col("script_host").alias("host"), root_domain("script_host").alias("registrable_domain"), first_party("page_host", "script_host").alias("is_first_party"))


def warnings(rows: DataFrame) -> DataFrame:
    """How many pages lack a title or a description."""
    return rows.agg(F.count_if(F.coalesce("title", F.lit("")) == "").alias("missing_title"), F.count_if(F.col("description").isNull()).alias("missing_description"))
