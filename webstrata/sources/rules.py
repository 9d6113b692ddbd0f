"""Rule packs: JSON technology rules and TOML secret rules, read on the driver and shipped as small objects.

Rule packs are configuration, bounded by hand-written files, so they go along with the tasks' code."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from urllib.request import urlopen

from webstrata.functions.literals import Gate

# --- technologies -----------------------------------------------------------------------------------------------------

#: A sample pack over every channel, for when none is given. Its products are invented; real packs are read from a path or URL.
SAMPLE_PACK = {
    "Sample Server": {"cats": [1], "headers": {"Server": r"^sampled/(\d\S*)\;version:\1"}, "implies": ["Sample Language\\;version:8"]},
    "Sample Language": {"cats": [2], "headers": {"X-Runtime": r"\bsamplang (\d\S*)\;version:\1"}, "cookies": {"SAMPLESESSION": "", "smp_*": ""}},
    "Sample CMS": {"cats": [3], "meta": {"generator": r"^sample cms v(\d\S*)\;version:\1"}, "html": ["class=\"scms-"], "implies": ["Sample Language"]},
    "Sample Shop": {"cats": [4], "scriptSrc": [r"/sample-shop/cart\.js(?:\?v=(\d\S*))?\;version:\1"], "implies": ["Sample CMS"]},
    "Sample Widgets": {"cats": [5], "scriptSrc": [r"widgets@(\d+\.\d+)/all\.js\;version:\1"], "scripts": [r"samplewidgets\.boot\(\"(\d\S*)\"\;version:\1"], "js": {"sample-widgets": ""}},
    "Example CDN": {"cats": [6], "scriptSrc": [r"cdn\d+\.example\.net"], "excludes": ["Other CDN"]},
    "Other CDN": {"cats": [6], "scriptSrc": ["example.net"]},
    "Sample Counter": {"cats": [7], "scripts": ["samplecount("], "dns": {"TXT": ["sample-counter-site"]}, "certIssuer": ["sample counter ca"]},
}
SAMPLE_CATEGORIES = {"1": {"name": "Web servers"}, "2": {"name": "Programming languages"}, "3": {"name": "CMS"}, "4": {"name": "Ecommerce"}, "5": {"name": "JavaScript libraries"}, "6": {"name": "CDN"}, "7": {"name": "Analytics"}}
MAPS = ("headers", "cookies", "meta", "dns", "js")
LISTS = ("scriptSrc", "scripts", "html", "url", "certIssuer")


def many(x) -> list[str]:
    return [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]


def required(expression: str) -> str:
    """The longest run of plain ASCII characters that any match must hold; empty where that isn't plain to see."""
    if re.search(r"\(\?[a-z]*x", expression):  # blanks and comments inside
        return ""
    runs, run, depth, at = [], "", 0, 0
    while at < len(expression):
        c, step, plain = expression[at], 1, False
        if c == "\\":
            step, c = 2, expression[at + 1 : at + 2]
            plain = not c.isalnum()
            if c and c in "xuUN0123456789":
                return ""
        elif c == "|" and depth == 0:
            return ""
        elif c == "[":
            step = class_length(expression, at)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{":
            step = max(expression.find("}", at) - at, 0) + 1
        else:
            plain = c not in "^$.*+?{}"
        if depth or not plain or not c.isascii():
            if (c == "{" or (c in "*?" and step == 1)) and not depth:
                run = run[:-1]  # the character before may be missing
            runs.append(run)
            run = ""
        else:
            run += c.lower()
        at += step
    return max([*runs, run], key=len)


def class_length(expression: str, at: int) -> int:
    """How long the character class is that begins at `at`: brackets in it are escaped or come first."""
    end = at + 1 + expression.startswith("^", at + 1)
    end += expression.startswith("]", end)
    while end < len(expression) and expression[end] != "]":
        end += 2 if expression[end] == "\\" else 1
    return end + 1 - at


def ascii_run(text: str) -> str:
    return max(re.split(r"[^\x00-\x7f]+", text.lower()), key=len)


@dataclass
class Pattern:
    r"""A rule's pattern with its version template: `expression\;version:...`; other parts are ignored."""

    text: str
    version: str | None = None
    regex: re.Pattern | None = None
    literal: str = ""  # what any match holds, in lower case; scans ask for it before they try the expression

    @classmethod
    def of(cls, raw: str) -> Pattern:
        text, *rest = raw.strip().split(r"\;")
        version = next((p.removeprefix("version:") for p in rest if p.startswith("version:")), None)
        if not text:
            return cls("", version)
        special = text.startswith("^") or any(c in text for c in "$\\[(*+?")
        try:
            return cls(text, version, re.compile(text if special else re.escape(text), re.IGNORECASE), required(text) if special else ascii_run(text))
        except re.error:
            return cls(text.lower(), version, None, ascii_run(text))

    def match(self, value: str) -> tuple[bool, str | None]:
        """Whether it fits, and the version that comes out."""
        if not self.text:
            return True, self.version if self.version and "\\" not in self.version else None
        if self.regex is None:
            return self.text in value.lower(), None
        m = self.regex.search(value)
        return (True, rendered(self.version, m)) if m else (False, None)


def rendered(template: str | None, m: re.Match) -> str | None:
    r"""A version template filled in: \1 is a group; \1?a:b is a where the pattern has that group, else b."""
    if not template or not template.strip():
        return None
    text = template.strip()
    used = {int(x) for x in re.findall(r"\\(\d+)", text)}
    if ternary := re.match(r"\\(\d+)\?([^:]*):(.*)$", text):
        group, yes, no = ternary.groups()
        text = yes if int(group) <= (m.re.groups or 0) else no
    for g in sorted(used, reverse=True):
        if g <= m.re.groups:
            text = text.replace(f"\\{g}", m.group(g) or "")
    text = re.sub(r"\\\d+", "", text).strip()
    if ";" in text and len(used) <= 1:
        text = text.split(";")[0].strip()
    return text or None


@dataclass
class Technology:
    name: str
    category: str | None
    maps: dict[str, dict[str, list[Pattern]]] = field(default_factory=dict)
    lists: dict[str, list[Pattern]] = field(default_factory=dict)
    implies: list[tuple[str, str | None]] = field(default_factory=list)  # name, version
    excludes: list[str] = field(default_factory=list)


def technologies(pack: dict | None = None, categories: dict | None = None) -> list[Technology]:
    pack, categories = (SAMPLE_PACK, SAMPLE_CATEGORIES) if pack is None else (pack, categories or {})
    out = []
    for name, raw in sorted(pack.items()):
        maps = {k: {key.lower(): [Pattern.of(p) for p in many(v) or [""]] for key, v in (raw.get(k) or {}).items()} if isinstance(raw.get(k), dict) else {key.lower(): [Pattern.of("")] for key in many(raw.get(k))} for k in MAPS if raw.get(k)}
        cats = many(raw.get("cats"))
        bare = lambda x: [v.split(r"\;")[0].strip() for v in many(x)]
        with_version = [(n, Pattern.of(v).version) for n, v in zip(bare(raw.get("implies")), many(raw.get("implies")), strict=True)]
        out.append(Technology(name, (categories.get(cats[0]) or {}).get("name") if cats else None, maps, {k: [Pattern.of(p) for p in many(raw.get(k))] for k in LISTS if raw.get(k)}, with_version, bare(raw.get("excludes"))))
    return out


def read_text(path: str) -> str:
    """The text of a file, or of an http(s) or file URL; packs are small."""
    if "://" in path:
        with urlopen(path, timeout=30) as answer:
            return answer.read().decode()
    return Path(path).read_text()


def read_technologies(path: str, categories: str | None = None) -> list[Technology]:
    """A pack from one JSON file or URL, or from all JSON files of a folder."""
    folder = Path(path) if "://" not in path and Path(path).is_dir() else None
    pack: dict = {}
    for name in [str(f) for f in sorted(folder.glob("*.json")) if f.name != "categories.json"] if folder else [path]:
        data = json.loads(read_text(name))
        pack |= data.get("technologies", data)
    if not categories and folder and (folder / "categories.json").exists():
        categories = str(folder / "categories.json")
    return technologies(pack, json.loads(read_text(categories)) if categories else {})


def implied(rules: list[Technology], rounds: int = 10) -> dict[str, dict[str, str | None]]:
    """For each technology all that it implies, directly or in up to `rounds` steps, with the version that comes along: that of the
    first step to name one. Only known names."""
    names = {t.name for t in rules}
    known = {t.name: [(i, v) for i, v in t.implies if i in names] for t in rules}
    out = {}
    for name in known:
        seen: dict[str, str | None] = {}
        edge = [name]
        for _ in range(rounds):
            found: dict[str, str | None] = {}
            for e in edge:
                for i, v in known.get(e, []):
                    if i != name:
                        if i not in seen:
                            found[i] = found.get(i) or v
                        elif v and not seen[i]:
                            seen[i] = v
            if not found:
                break
            seen |= found
            edge = list(found)
        out[name] = dict(sorted(seen.items()))
    return out


# --- secrets ----------------------------------------------------------------------------------------------------------

#: What may follow a secret: as published packs have it for source code, and widened for web pages; fixed values.
STRICT_END = r"""(?:[\x60'"\s;]|\\[nr]|$)"""
WEB_END = r"""(?:[\x60'"\s;&,)\]}></?#]|\\[nr]|$)"""

#: A sample pack, written from what the issuers publish of their formats, for when none is given.
SAMPLE_RULES = r"""
[allowlist]
regexes = ['(?i)^(?:example|sample|changeme|placeholder)']
stopwords = ["dummy"]
[[rules]]
id = "aws-access-key"
regex = '''(?<![0-9A-Za-z])(A[KS]IA[0-9A-Z]{16})(?![0-9A-Za-z])'''
entropy = 2.5
keywords = ["akia", "asia"]
[[rules]]
id = "gcp-api-key"
regex = '''(?<![\w-])(AIzaSy[0-9A-Za-z_-]{33})(?![\w-])'''
entropy = 3
keywords = ["aizasy"]
[[rules]]
id = "github-token"
regex = '''(?<!\w)(gh[oprsu]_[0-9A-Za-z]{36,})(?!\w)'''
entropy = 3
keywords = ["gho_", "ghp_", "ghr_", "ghs_", "ghu_"]
[[rules]]
id = "private-key"
regex = '''-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[\s\S]{16,16384}?-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----'''
keywords = ["private key-----"]
[[rules]]
id = "jwt"
regex = '''(?<![\w.-])(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]*)(?![\w.-])'''
entropy = 3
keywords = ["eyj"]
[[rules]]
id = "generic-token"
regex = '''(?i)(?:token|secret|api_?key)["']?\s*[:=]\s*["']?([a-z0-9_\-]{16,64})(?![\w-])'''
entropy = 3.3
keywords = ["token", "secret", "apikey", "api_key"]
[[rules.allowlists]]
regexTarget = "line"
regexes = ['(?i)csrf']
"""

#: Severity of rules by words in their names; the first that occurs counts.
SEVERITIES = [("gcp-api-key", "low"), ("private-key", "critical"), ("aws", "critical"), ("stripe", "critical"), ("github", "high"), ("gitlab", "high"), ("slack", "high"), ("jwt", "medium"), ("generic", "low")]


def severity(rule_id: str) -> str:
    return next((level for word, level in SEVERITIES if word in rule_id), "medium")


@dataclass
class Allow:
    regexes: list[re.Pattern]
    stopwords: list[str]
    target: str | None = None
    all_of: bool = False
    has_paths: bool = False


@dataclass
class SecretRule:
    id: str
    regex: re.Pattern
    group: int | None
    entropy: float | None
    keywords: list[str]
    severity: str
    allow: list[Allow] = field(default_factory=list)


@dataclass
class SecretRules:
    rules: list[SecretRule]
    allow: Allow
    dropped: list[str]  # ids of rules whose expression this engine can't take
    of_paths: list[str] = field(default_factory=list)  # ids of rules for files of certain names, which texts of pages never are

    def __post_init__(self):
        self.gate = Gate([(r.keywords, required(r.regex.pattern)) for r in self.rules])

    def running(self, text: str) -> list[SecretRule]:
        """The rules that can find anything in a text, by one pass over it."""
        return [self.rules[i] for i in self.gate.open(text)]


def compiled(pattern: str) -> re.Pattern | None:
    """An expression of the packs' dialect in Python's: inline flags move to the front, \\z is \\Z, POSIX classes are spelt out."""
    text = pattern.replace(r"\z", r"\Z").replace("[[:alnum:]]", "[a-zA-Z0-9]").replace("[:alnum:]", "a-zA-Z0-9").replace("[:alpha:]", "a-zA-Z").replace("[:digit:]", "0-9")
    flags = re.IGNORECASE if "(?i)" in text else 0
    at = text.find("(?i)")
    if at > 0:  # a flag in the middle holds from there on only
        text, flags = f"{text[:at]}(?i:{text[at + 4 :].replace('(?i)', '')})", 0
    try:
        return re.compile(text.replace("(?i)", "") if flags else text, flags)
    except re.error:
        return None


def allow_of(raw: dict) -> Allow:
    return Allow([r for p in raw.get("regexes", []) if (r := compiled(p))], [w.lower() for w in raw.get("stopwords", [])], raw.get("regexTarget"), str(raw.get("condition", "")).upper() in ("AND", "&&"), bool(raw.get("paths")))


def secret_rules(text: str = SAMPLE_RULES, overrides: str | None = None) -> SecretRules:
    """Rules from TOML text. Overrides replace rules of the same id (their ends aren't widened), add new ones, and append allowlists."""
    pack, over = tomllib.loads(text), tomllib.loads(overrides) if overrides else {}
    own = {r["id"] for r in over.get("rules", [])}
    rules, dropped, of_paths = [], [], []
    for relaxed, raw in [*[(True, r) for r in pack.get("rules", []) if r["id"] not in own], *[(False, r) for r in over.get("rules", [])]]:
        if raw.get("path"):
            of_paths.append(raw["id"])
            continue
        if not raw.get("regex"):
            continue
        regex = compiled(raw["regex"].replace(STRICT_END, WEB_END) if relaxed else raw["regex"])
        if regex is None:
            dropped.append(raw["id"])
            continue
        extra = [x for a in over.get("append", []) if a.get("id", a.get("rule")) == raw["id"] for x in [*a.get("allowlists", []), *([a["allowlist"]] if "allowlist" in a else [])]]
        lists = [allow_of(a) for a in [*raw.get("allowlists", []), *([raw["allowlist"]] if "allowlist" in raw else []), *extra]]
        rules.append(SecretRule(raw["id"], regex, raw.get("secretGroup"), raw.get("entropy"), [k.lower() for k in raw.get("keywords", [])], severity(raw["id"]), lists))
    general = pack.get("allowlist") or (pack.get("allowlists") or [{}])[0]
    return SecretRules(rules, allow_of(general), dropped, of_paths)
