"""Secret scanning: a rule pack over texts in one Arrow-batched pass, with decoded token claims as native expressions.

A rule runs where one of its keywords occurs (or it has none) and what its expression requires; one pass of an automaton over
a text tells for all rules. The secret is the rule's group, else the first non-empty group, else the whole match. It is
dropped under the rule's entropy or by an allowlist, of which those on lines see the whole line, however long. The locations
of findings are our own definition: the innermost of script, JSON-LD block, comment, data attribute, meta tag and URL
parameter around them.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.scalar import jwt, wrapped_jwt
from webstrata.sources.rules import Allow, SecretRule, SecretRules, secret_rules

FOUND = "array<struct<secret_type: string, matched_value: string, severity: string, location: string, context: string>>"
AROUND = 80
#: Up to so many keywords the JVM looks for them first, so that most texts never reach Python; beyond, the automaton's one pass is cheaper.
FEW = 16
PLACES = [
    ("html_comment", re.compile(r"<!--"), "-->"), ("json_ld", re.compile(r"<script[^>]*ld\+json[^>]*>", re.I), "</script>"), ("inline_script", re.compile(r"<script(?![^>]*\bsrc\s*=)[^>]*>", re.I), "</script>"),
    ("meta_tag", re.compile(r"<meta\b[^>]*>", re.I), None), ("data_attribute", re.compile(r"""\bdata-[\w-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), None), ("url_parameter", re.compile(r"""https?://[^\s"'<>?]*\?[^\s"'<>]*"""), None),
]


def spans_of(start: re.Pattern, end: str | None, text: str, low: str) -> list[tuple[int, int]]:
    """Where a place begins and ends; an end that is missing is looked for once only."""
    if end is None:
        return [m.span() for m in start.finditer(text)]
    out, at = [], 0
    while m := start.search(text, at):
        to = low.find(end, m.end()) if len(low) == len(text) else text.lower().find(end, m.end())
        if to < 0:
            break
        at = to + len(end)
        out.append((m.start(), at))
    return out


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


class Lines:
    """The whole lines of a text around matches. What an allowlist says of a line is kept while matches stay on it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.said = text, 0, -1, {}

    def allow(self, a: Allow, m: re.Match) -> bool:
        if not (self.start <= m.start() and m.end() <= self.end):
            end = self.text.find("\n", m.end())
            self.start, self.end, self.said = self.text.rfind("\n", 0, m.start()) + 1, len(self.text) if end < 0 else end, {}
        if id(a) not in self.said:
            self.said[id(a)] = any(r.search(self.text[self.start : self.end]) for r in a.regexes)
        return self.said[id(a)]


def allowed(a: Allow, secret: str, m: re.Match | None = None, lines: Lines | None = None) -> bool:
    """Whether an allowlist lets the finding go. Its expressions look at the secret, the match or the line; its words at the secret."""
    if m is not None and a.target == "line":
        by_regex = bool(a.regexes) and lines.allow(a, m)
    else:
        by_regex = any(r.search(m.group(0) if m is not None and a.target == "match" else secret) for r in a.regexes)
    by_word = any(w in secret.lower() for w in a.stopwords)
    if a.all_of:
        return not a.has_paths and (by_regex or not a.regexes) and (by_word or not a.stopwords) and bool(a.regexes or a.stopwords)
    return by_regex or by_word


def secret_of(rule: SecretRule, m: re.Match) -> str:
    if rule.group is not None and rule.group <= m.re.groups and m.group(rule.group):
        return m.group(rule.group)
    return next((g for g in m.groups() if g), m.group(0))


def scan(text: str | None, pack: SecretRules, place: str | None = None) -> list[dict]:
    """Findings of one text, each (type, value) once. `place` is the location of texts that are no pages."""
    if not text:
        return []
    seen, out, spans, lines = set(), [], None, Lines(text)
    for rule in pack.running(text):
        for m in rule.regex.finditer(text):
            secret = secret_of(rule, m)
            if (rule.id, secret) in seen or (rule.entropy is not None and entropy(secret) <= rule.entropy):
                continue
            if allowed(pack.allow, secret) or any(allowed(a, secret, m, lines) for a in rule.allow):
                continue
            seen.add((rule.id, secret))
            if place is None and spans is None:
                low = text.lower()
                spans = [(name, spans_of(start, end, text, low)) for name, start, end in PLACES]
            where = place or next((name for name, own in spans if any(a <= m.start() < b for a, b in own)), "html_body")
            out.append({"secret_type": rule.id, "matched_value": secret, "severity": rule.severity, "location": where, "context": text[max(0, m.start() - AROUND) : m.end() + AROUND]})
    return out


def exposed(rows: DataFrame, key: str, text: str, pack: SecretRules | None = None, location: str | None = None) -> DataFrame:
    """(key, secret_type, matched_value, severity, location, context) of a text column. Texts without any keyword skip Python."""
    return found_in(rows.select(key, F.lit(location).alias("place"), F.col(text).alias("body")), key, pack)


def found_in(texts: DataFrame, key: str, pack: SecretRules | None = None) -> DataFrame:
    """The findings of texts (key, place, body); place null means a page, whose findings are located by what is around them."""
    pack = secret_rules() if pack is None else pack
    words = sorted({k for r in pack.rules for k in r.keywords})
    if all(r.keywords for r in pack.rules) and len(words) <= FEW:  # the outer lambda lowers a text once, not once a keyword
        literals = F.array(*[F.lit(w) for w in words])
        texts = texts.where(F.exists(F.array(F.lower("body")), lambda low: F.exists(literals, lambda w: F.contains(low, w))))

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, places in batches:
            yield pd.Series([scan(b, pack, p if isinstance(p, str) else None) if isinstance(b, str) else [] for b, p in zip(bodies, places, strict=True)], dtype=object)

    return texts.select(key, F.explode(run("body", "place")).alias("s")).select(key, "s.*")


def exposed_of_answers(rows: DataFrame, key: str, html: str, headers: str | None = None, cookies: str | None = None, scripts: str | None = None, pack: SecretRules | None = None) -> DataFrame:
    """Findings of whole answers: the page, its headers (a map) but for cookies, its Set-Cookie values (an array), and its external
    scripts (a map from URL to text). A (type, value) of a key counts once, at the first of these places."""
    texts = [F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("place"), F.col(html).alias("body"))]
    if headers:
        texts.append(F.struct(F.lit(1).alias("n"), F.lit("response_header").alias("place"), header_text(F.map_filter(headers, lambda k, v: F.lower(k) != "set-cookie")).alias("body")))
    if cookies:
        texts.append(F.struct(F.lit(2).alias("n"), F.lit("set_cookie").alias("place"), F.array_join(cookies, "\n").alias("body")))
    every = F.array(*texts)
    if scripts:
        own = F.transform(F.map_entries(scripts), lambda e: F.struct(F.lit(3).alias("n"), F.concat(F.lit("external_script:"), e["key"]).alias("place"), e["value"].alias("body")))
        every = F.concat(every, F.coalesce(own, F.array().cast("array<struct<n: int, place: string, body: string>>")))
    each = rows.select(key, F.explode(every).alias("t")).where("t.body IS NOT NULL AND t.body <> ''").select(F.struct(key, "t.n").alias("k"), "t.place", "t.body")
    found = found_in(each, "k", pack)
    first = F.min_by(F.struct("severity", "location", "context"), F.struct("k.n", "location"))
    return found.groupBy(F.col(f"k.{key}").alias(key), "secret_type", "matched_value").agg(first.alias("f")).select(key, "secret_type", "matched_value", "f.*")


def header_text(headers):
    """A header map as lines, for scanning."""
    return F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")


def token_claims(secrets: DataFrame, key: str) -> DataFrame:
    """Decoded claims of findings that are tokens, one row each; findings that don't decode have none."""
    claims = F.when(F.col("secret_type") == "jwt-base64", wrapped_jwt("matched_value")).when(F.col("secret_type") == "jwt", jwt("matched_value"))
    return secrets.select(key, "matched_value", claims.alias("c")).where("c IS NOT NULL").select(key, "matched_value", "c.*")
