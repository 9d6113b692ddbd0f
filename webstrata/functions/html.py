"""What one HTML page says, by one pass of the tokenizer in functions.markup in an Arrow-batched function.

Built-in expressions can't parse HTML; this is the one place where Python reads pages. Everything derived from the parts
(analytics, social links, contacts, script hosts) is native and lives in operators.extract.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.markup import Tokenizer

SCHEMA = """title string, title_source string, description string, canonical_url string, favicon_href string, meta array<struct<key: string, content: string>>, script_sources array<string>, script_ids array<string>,
inline_script string, hints array<struct<hint_type: string, href: string>>, hrefs array<string>, json_ld array<string>, comments array<string>"""
HINTS = ("preconnect", "dns-prefetch", "preload", "prefetch", "modulepreload")
#: Script sources also where the markup holds no script element, as in comments; a fixed value.
SCRIPT_SRC = re.compile(r"""<script[^>]*src\s*=\s*["']([^"']+)["']""", re.I)
TITLE, TITLE_END = re.compile("<title", re.I | re.A), re.compile("</title>", re.I | re.A)


class Page(Tokenizer):
    def __init__(self, body: str):
        self.title_parts: list[str] | None = None
        self.title_done = self.in_title = False
        self.script: dict | None = None
        self.script_text: list[str] = []
        self.inline: list[str] = []
        self.out: dict = {"title": "", "title_source": title_source(body), "description": None, "canonical_url": None, "favicon_href": None, "meta": [], "script_sources": [], "script_ids": [], "inline_script": "", "hints": [], "hrefs": [], "json_ld": [], "comments": []}
        self.read(body)
        self.end_script()
        if self.title_parts is not None:
            self.out["title"] = "".join(self.title_parts).strip()
        self.out["inline_script"] = "\n".join(self.inline).lower()
        known = set(self.out["script_sources"])
        for src in SCRIPT_SRC.findall(body):
            if src not in known:
                known.add(src)
                self.out["script_sources"].append(src)

    def start(self, tag, a):
        if tag == "title" and not self.title_done:
            self.in_title, self.title_parts = True, []
        elif tag == "meta" and "content" in a:
            for kind in ("name", "property", "http-equiv"):
                if kind in a:
                    self.out["meta"].append({"key": f"{kind}:{a[kind].lower()}", "content": a["content"]})
            if a.get("name") == "description" and self.out["description"] is None:
                self.out["description"] = a["content"].strip()
        elif tag == "link":
            self.link(a)
        elif tag == "a" and "href" in a:
            self.out["hrefs"].append(a["href"])
        elif tag == "script":
            self.end_script()
            if "id" in a and a["id"] not in self.out["script_ids"]:
                self.out["script_ids"].append(a["id"])
            if a.get("src"):
                self.out["script_sources"].append(a["src"])
            else:
                self.script = a

    def link(self, a):
        rel, href = a.get("rel", ""), a.get("href", "")
        if not href:
            return
        low = rel.strip().lower()
        if low == "canonical" and self.out["canonical_url"] is None:
            self.out["canonical_url"] = href
        if ("icon" in low.split() or low == "shortcut icon") and self.out["favicon_href"] is None:
            self.out["favicon_href"] = href
        if low in HINTS:
            if low in ("preconnect", "dns-prefetch"):
                host = re.sub(r"^(?:[a-z][a-z0-9+.-]*:)?//", "", href.strip().lower()).split("/")[0].split("?")[0].split(":")[0]
                if "." not in host:
                    return
                href = host
            entry = {"hint_type": low, "href": href}
            if entry not in self.out["hints"]:
                self.out["hints"].append(entry)

    def end_script(self):
        if self.script is None:
            return
        text, kind = "".join(self.script_text), self.script.get("type", "").lower()
        self.script, self.script_text = None, []
        if "ld+json" in kind:
            self.out["json_ld"].append(text.strip())
        elif "json" not in kind and text.strip() and text.strip()[0] not in "{[":
            self.inline.append(text)

    def end(self, tag):
        if tag == "title" and self.in_title:
            self.in_title, self.title_done = False, True
        elif tag == "script":
            self.end_script()

    def text(self, data):
        if self.in_title:
            self.title_parts.append(data)
        elif self.script is not None:
            self.script_text.append(data)

    def comment(self, data):
        self.out["comments"].append(data)


def title_source(body: str) -> str:
    """What stands between the first title tags as it is written, references and blanks kept, wherever in the page they are."""
    m = TITLE.search(body)
    start = body.find(">", m.end()) + 1 if m else 0
    end = TITLE_END.search(body, start) if start else None
    return body[start : end.start()] if end else ""


def parse(body: str | None) -> dict:
    return Page(body or "").out


NAMES = ["title", "title_source", "description", "canonical_url", "favicon_href", "meta", "script_sources", "script_ids", "inline_script", "hints", "hrefs", "json_ld", "comments"]


def parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([parse(x) for x in s], columns=NAMES)


def page_parts(html: Column | str) -> Column:
    # the function is declared when it is used: workers import this module without a session
    return F.pandas_udf(parse_batches, SCHEMA)(html)
