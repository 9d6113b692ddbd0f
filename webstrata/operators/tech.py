"""Technology detection: a rule pack over pages, in one Arrow-batched pass, then native merging.

Channels are tried in the order headers, cookies, html, script sources, inline scripts, meta, url, script ids, DNS records,
certificate issuer, text of external scripts; a later one only while no version is known. A meta key is looked up among
names, then properties, then http-equiv. TXT rules search all TXT, SPF and DMARC records together. What a technology
implies, and with which version, is closed over the rule pack on the driver, so rows never recurse.

A text is read once by an automaton over all that the patterns of its channel require, and only patterns that it can fit are
tried; header, cookie, meta and DNS rules are looked up by the keys that a page has. So the cost of a page is its length and
what it may hold, not the number of rules."""

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.literals import Gate
from webstrata.functions.scalar import version_text
from webstrata.sources.rules import LISTS, MAPS, Pattern, Technology, implied, technologies

FOUND = "array<struct<technology_name: string, technology_version: string, rank: int>>"


def first_match(tries: Iterator[tuple[Pattern, str]]) -> tuple[bool, str | None]:
    """Whether a pattern fits its value, and the first version that comes out."""
    hit = False
    for p, v in tries:
        ok, version = p.match(v)
        if ok:
            hit = True
            if version:
                return True, version
    return hit, None


def keyed_match(rules: dict, values: dict) -> tuple[bool, str | None]:
    hit = False
    for key, patterns in rules.items():
        if key.endswith("*"):
            have = [v for k, vs in values.items() if k.startswith(key[:-1]) for v in vs]
        else:
            have = values.get(key, [])
        ok, version = first_match((p, v) for p in patterns for v in have)
        if ok and version:
            return True, version
        hit |= ok
    return hit, None


class Texts:
    """The patterns of a channel of texts."""

    def __init__(self, rules: list[Technology], channel: str):
        self.patterns = [(n, p) for n, t in enumerate(rules) for p in t.lists.get(channel, [])]
        self.gate = Gate([([], p.literal) for _, p in self.patterns])

    def tries(self, values: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Numbers of rules with the patterns and values that may fit, pattern by pattern."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for v, value in enumerate(values):
            for p in self.gate.open(value):
                out[self.patterns[p][0]].append((p, v))
        return {n: sorted(some) for n, some in out.items()}

    def match(self, n: int, some: list[tuple[int, int]], values: list[str]) -> tuple[bool, str | None]:
        return first_match((self.patterns[p][1], values[v]) for p, v in some)


class Keys:
    """The rules of a channel of keyed values, by key and by the beginnings of keys (name*)."""

    def __init__(self, rules: list[Technology], channel: str):
        self.maps = {n: t.maps[channel] for n, t in enumerate(rules) if channel in t.maps}
        self.whole: dict[str, set[int]] = defaultdict(set)
        self.begin: dict[int, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        for n, own in self.maps.items():
            for key in own:
                if key.endswith("*"):
                    self.begin[len(key) - 1][key[:-1]].add(n)
                else:
                    self.whole[key].add(n)
        self.begin = {size: dict(starts) for size, starts in self.begin.items()}

    def tries(self, values: dict[str, list[str]]) -> dict[int, None]:
        found: set[int] = set()
        for key in values:
            found |= self.whole.get(key, set())
            for size, starts in self.begin.items():
                found |= starts.get(key[:size], set())
        return dict.fromkeys(sorted(found))

    def match(self, n: int, _, values: dict[str, list[str]]) -> tuple[bool, str | None]:
        return keyed_match(self.maps[n], values)


class Matcher:
    def __init__(self, rules: list[Technology]):
        self.names = [t.name for t in rules]
        self.channels = {c: Texts(rules, c) for c in LISTS} | {c: Keys(rules, c) for c in MAPS}

    def detect(self, channels: list[tuple]) -> list[dict]:
        """Observed technologies of one page: {name, version, rank of the channel}."""
        best: dict[int, tuple[str | None, int]] = {}
        for rank, (channel, values) in enumerate(channels):
            own = self.channels[channel]
            for n, some in own.tries(values).items():
                version, first = best.get(n, (None, rank))
                if version:
                    continue
                ok, version = own.match(n, some, values)
                if ok:
                    best[n] = (version, first)
        return [{"technology_name": self.names[n], "technology_version": version, "rank": rank} for n, (version, rank) in sorted(best.items())]


def as_lists(m) -> dict[str, list[str]]:
    """A map column's value with lower-case keys and values as lists."""
    out: dict[str, list[str]] = {}
    for k, v in (m or {}).items() if isinstance(m, dict) else (m if m is not None else []):
        out.setdefault(str(k).lower(), []).append(str(v or ""))
    return out


def meta_values(meta) -> dict[str, list[str]]:
    """Contents by bare key: those under name, or else under property, or else under http-equiv."""
    by_kind: dict[str, dict[str, list[str]]] = {}
    for m in meta if meta is not None else []:
        kind, _, name = m["key"].partition(":")
        by_kind.setdefault(kind, {}).setdefault(name, []).append(m["content"] or "")
    out: dict[str, list[str]] = {}
    for kind in ("http-equiv", "property", "name"):  # the last one counts
        out |= by_kind.get(kind, {})
    return out


def dns_values(records) -> dict[str, list[str]]:
    """Record texts by type, in lower case; all of TXT, SPF and DMARC are one text under TXT."""
    out = {k: [x.lower() for x in v] for k, v in as_lists(records).items()}
    texts = [x for k in ("txt", "spf", "dmarc") for x in out.get(k, [])]
    return out | ({"txt": [" ".join(texts)]} if texts else {})


def channels_of(r) -> list[tuple]:
    values = lambda x: list(x) if x is not None else []
    return [
        ("headers", {k: [", ".join(v).lower()] for k, v in as_lists(r.headers).items()}), ("cookies", as_lists(r.cookies)), ("html", [r.html or ""]), ("scriptSrc", values(r.src)), ("scripts", [r.inline or ""]),
        ("meta", meta_values(r.meta)), ("url", [r.url or ""]), ("js", {i.lower(): [""] for i in values(r.ids)}), ("dns", dns_values(r.dns)), ("certIssuer", [r.issuer.lower()] if r.issuer else []),
        ("scripts", [x.lower() for x in values(r.external) if x]),
    ]


def observed(rows: DataFrame, rules: list[Technology], key: str = "page_id", html: str = "html", url: str = "url", headers: str | None = None, cookies: str | None = None, dns: str | None = None, issuer: str | None = None, external: str | None = None) -> DataFrame:
    """(key, technology_name, technology_version, rank) of rows that operators.extract.parsed() made; `external` is an array of the
    texts of the page's external scripts."""
    blank = F.lit(None).cast("map<string,string>")
    packed = F.struct(
        F.lower(html).alias("html"), F.col(url).alias("url"), F.col("p.script_sources").alias("src"), F.col("p.inline_script").alias("inline"), F.col("p.meta").alias("meta"), F.col("p.script_ids").alias("ids"),
        (F.col(headers) if headers else blank).alias("headers"), (F.col(cookies) if cookies else blank).alias("cookies"), (F.col(dns) if dns else blank).alias("dns"), (F.col(issuer) if issuer else F.lit(None).cast("string")).alias("issuer"),
        (F.col(external) if external else F.lit(None).cast("array<string>")).alias("external"),
    )

    matcher = Matcher(rules)

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for df in batches:
            yield pd.Series([matcher.detect(channels_of(r)) for r in df.itertuples(index=False)], dtype=object)

    return rows.select(key, F.explode(run(packed)).alias("t")).select(key, "t.*")


def with_implied(found: DataFrame, rules: list[Technology], key: str = "page_id") -> DataFrame:
    """(key, technology_name, technology_version, technology_category, is_implied): merged, closed under `implies`, without the excluded."""
    spark = found.sparkSession
    closure = [(t, i, v) for t, many in implied(rules).items() for i, v in many.items()]
    excludes = [(t.name, x) for t in rules for x in t.excludes]
    categories = [(t.name, t.category) for t in rules]
    table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  a rule pack's size
    more = found.join(table(closure, "technology_name string, other string, version string"), "technology_name").select(key, F.col("other").alias("technology_name"), version_text("version").alias("technology_version"), F.lit(99).alias("rank"), F.lit(True).alias("is_implied"))
    rows = found.withColumn("is_implied", F.lit(False)).withColumn("technology_version", version_text("technology_version")).unionByName(more)
    known = F.when(F.col("technology_version").isNotNull(), F.col("rank"))
    merged = rows.groupBy(key, "technology_name").agg(F.min_by("technology_version", known).alias("technology_version"), F.bool_and("is_implied").alias("is_implied"))
    out = merged.join(table(excludes, "technology_name string, gone string"), "technology_name").select(key, F.col("gone").alias("technology_name")).distinct()
    return merged.join(out, [key, "technology_name"], "left_anti").join(table(categories, "technology_name string, technology_category string"), "technology_name", "left").select(key, "technology_name", "technology_version", "technology_category", "is_implied")


def technologies_of(rows: DataFrame, rules: list[Technology] | None = None, key: str = "page_id", **columns) -> DataFrame:
    rules = technologies() if rules is None else rules
    return with_implied(observed(rows, rules, key, **columns), rules, key)
