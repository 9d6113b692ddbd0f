"""Registrable domains by the public suffix list, and URL resolution.

The list is package data (data/public_suffix_list.dat, under its own licence); a caller may pass other rules. It is a trie of
labels from the right, built once a Python worker, and a host is one walk down it: the cost is the host's labels, whatever
the number of rules. Names under an unlisted suffix count as if the suffix were their last label, as the list's default
rule has it. The lookup is an Arrow function over the distinct hosts of a batch that carries its own table, so it holds in
any session; URL resolution and percent decoding are column expressions.
"""

from collections.abc import Callable
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.scalar import col, url_host

#: What ends at a node of the trie: nothing, a rule, a rule for all labels below (*.name), an exception (!name).
NOTHING, RULE, BELOW, EXCEPT = 0, 1, 2, 4


@lru_cache(maxsize=1)
def public_suffixes() -> tuple[str, ...]:
    """The rules of the public suffix list, private ones included: names, *.name and !name; other alphabets also as ASCII."""
    lines = files("webstrata").joinpath("data/public_suffix_list.dat").read_text(encoding="utf-8").splitlines()
    rules = [line.split()[0].lower() for line in lines if line.strip() and not line.startswith("//")]
    return tuple(sorted({form for r in rules for form in (r, ascii_form(r))}))


def ascii_form(rule: str) -> str:
    mark = rule[: 2 if rule.startswith("*.") else 1 if rule.startswith("!") else 0]
    return rule if rule.isascii() else mark + ".".join(x.encode("idna").decode() for x in rule[len(mark) :].split("."))


class SuffixTrie:
    """Labels from the right: a node is [what ends here, label to node]."""

    def __init__(self, rules: tuple[str, ...]):
        self.root: list = [NOTHING, {}]
        for rule in rules:
            kind = BELOW if rule.startswith("*.") else EXCEPT if rule.startswith("!") else RULE
            name = rule.removeprefix("*.").removeprefix("!")
            if not name or "*" in name:
                raise ValueError(f"a wildcard may only be the first label of a rule: {rule}")
            node = self.root
            for label in reversed(name.split(".")):
                node = node[1].setdefault(label, [NOTHING, {}])
            node[0] |= kind

    def size(self, labels: list[str]) -> int:
        """How many of a host's last labels are its public suffix: those of the longest rule, or of the exception less one."""
        best, node = 1, self.root
        for depth, label in enumerate(reversed(labels), 1):
            node = node[1].get(label)
            if node is None:
                break
            if node[0] & EXCEPT:
                return depth - 1
            if node[0] & RULE:
                best = depth
            if node[0] & BELOW and depth < len(labels):
                best = depth + 1
        return best

    def registrable(self, host: str) -> str | None:
        h = host.removesuffix(".").lower()
        labels = h.split(".")
        if is_address(h, labels):
            return h
        n = self.size(labels) + 1
        return ".".join(labels[-n:]) if len(labels) >= n and all(labels) else None

    def root_domain(self, host: str) -> str | None:
        h = host.lower()
        labels = h.split(".")
        found = self.registrable(h)
        return h if found is None and len(labels) > 1 and len(labels) <= self.size(labels) and not is_address(h, labels) else found


@lru_cache(maxsize=4)
def trie(rules: tuple[str, ...] | None) -> SuffixTrie:
    """Built where it is used: the package's own list doesn't travel with a plan, other rules (a rule file's size) do."""
    return SuffixTrie(public_suffixes() if rules is None else rules)


def is_address(h: str, labels: list[str]) -> bool:
    return ":" in h or (len(labels) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 for x in labels))


def by_host(look: Callable[[SuffixTrie, str], str | None], rules: tuple[str, ...] | None) -> Callable[[Column], Column]:
    """A column function that looks up each distinct host of an Arrow batch once."""

    def run(hosts: pa.Array) -> pa.Array:
        own = trie(rules)
        known = hosts.cast(pa.string()).dictionary_encode()
        values = pa.array([None if h is None else look(own, h) for h in known.dictionary.to_pylist()], pa.string())
        return pc.take(values, known.indices)

    # the function is declared when it is used: workers import this module without a session
    return F.arrow_udf(run, "string")


def registrable(host: Column | str, rules: tuple[str, ...] | None = None) -> Column:
    """eTLD+1 of a host; an IP literal stays; null for a bare suffix, a single label or nothing."""
    return by_host(SuffixTrie.registrable, rules)(col(host))


def root_domain(host: Column | str, rules: tuple[str, ...] | None = None) -> Column:
    """Like registrable(), but a host that is itself a suffix stays."""
    return by_host(SuffixTrie.root_domain, rules)(col(host))


def url_domain(url: Column | str) -> Column:
    u = col(url)
    return registrable(url_host(F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))))


#: Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B); a fixed value.
REFERENCE = r"^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"


def part(text: Column, n: int) -> Column:
    return F.regexp_extract(text, REFERENCE, n)


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out."""
    names = F.split(F.regexp_replace(path, "^/", ""), "/")
    drop_last = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, s: F.when(s == "..", drop_last(kept)).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    ends_in_folder = F.element_at(names, -1).isin(".", "..")
    tidy = F.concat(F.lit("/"), F.array_join(F.when(ends_in_folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), tidy).otherwise(path)


def url_join(base: Column | str, ref: Column | str) -> Column:
    """RFC 3986 resolution; null where either is missing, blank or no http(s) URL comes out."""
    b, given = col(base), F.regexp_replace(col(ref), r"^\s+|\s+$", "")
    scheme_of = lambda u: F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    same = scheme_of(given) == scheme_of(b)
    # a scheme that the base has too says nothing where no authority follows
    r = F.when(same & ~given.rlike("^[^:]*://"), F.regexp_replace(given, "^[^:]*:", "")).otherwise(given)
    absolute = scheme_of(r) != ""
    rest = F.when(absolute, r).otherwise(F.concat(F.lit("x:"), r))  # so that a colon in a path opens no scheme
    host, path, query, fragment = part(rest, 2), part(rest, 4), part(rest, 5), part(rest, 6)
    own = absolute | (host != "")
    folder = F.regexp_extract(part(b, 4), "^(.*/)", 1)
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), path)
    to_path = F.when(own | path.startswith("/"), path).when(path == "", part(b, 4)).otherwise(merged)
    to_query = F.when(~own & (path == "") & (query == ""), part(b, 5)).otherwise(query)
    out = F.concat(F.when(absolute, scheme_of(r)).otherwise(scheme_of(b)), F.lit(":"), F.when(own, host).otherwise(part(b, 2)), F.when(absolute, to_path).otherwise(without_dots(to_path)), to_query, fragment)
    return F.when((given != "") & out.rlike(r"^https?://(?:[^/?#@]*@)?[^/?#@:]"), out)


def percent_decoded(text: Column | str) -> Column:
    """%XX decoded, broken escapes and + kept, invalid UTF-8 replaced."""
    t = col(text)
    safe = F.regexp_replace(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(t, F.lit("%")), F.url_decode(safe)).otherwise(t)


#: Hosts whose scripts are never the site's own; fixed values.
THIRD_PARTY = [
    "js.stripe.com", "consent.cookiebot.com", "assets.squarespace.com", "www.google-analytics.com", "www.googletagmanager.com", "connect.facebook.net", "maps.googleapis.com", "cdn.jsdelivr.net", "cdnjs.cloudflare.com",
    "unpkg.com", "ajax.googleapis.com", "fast.wistia.com", "hcaptcha.com", "www.google.com", "imasdk.googleapis.com", "static.cloudflareinsights.com", "cdn.weglot.com",
]


def first_party(page_host: Column | str, script_host: Column | str) -> Column:
    p, s = col(page_host), F.regexp_replace(F.lower(col(script_host)), r"\.$", "")
    known = F.exists(F.array(*[F.lit(x) for x in THIRD_PARTY]), lambda x: (s == x) | s.endswith(F.concat(F.lit("."), x)))
    return F.coalesce(~known & ((p == s) | (root_domain(p) == root_domain(s))), F.lit(False))
