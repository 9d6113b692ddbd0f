"""Tags, text and comments of an HTML page, by the tokenizer states of the HTML standard.

Where a page is no tree, the standard still says what each byte is: titles and text areas hold text with character
references, styles and frames raw text, scripts their own three states with comments and scripts within, and attributes end
where their quotes do. Each state is one search for what can end it, so a page is read in jumps and not letter by letter.
Within svg and math elements there are no such contents, until an element that can't stand there.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

#: Elements by what they hold, and those that end svg or math content; fixed values.
WITH_REFERENCES = {"title", "textarea"}
RAW = {"style", "xmp", "iframe", "noembed", "noframes", "noscript"}
BREAK_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

BLANK = "\t\n\f\r "
NAME = re.compile(r"[^\t\n\f\r />]*")
BETWEEN = re.compile(r"[\t\n\f\r /]*")
BLANKS = re.compile(r"[\t\n\f\r ]*")
ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I)
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;?)(?=(=?))")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def attribute_text(value: str) -> str:
    """Character references of an attribute: a named one without its semicolon counts only if no letter, digit or = follows."""

    def decoded(m: re.Match) -> str:
        name = m.group(1)
        if name.startswith("#") or name in html5 and (name.endswith(";") or not m.group(2)):
            return unescape(m.group(0))
        return m.group(0)

    return REFERENCE.sub(decoded, value) if "&" in value else value


class Tokenizer:
    """Calls start(tag, attributes), end(tag), text(data) and comment(data) for a page. Names are in lower case; of attributes of one
    name the first counts; carriage returns are line ends and zero bytes replacement characters."""

    def start(self, tag: str, attributes: dict[str, str]) -> None: ...

    def end(self, tag: str) -> None: ...

    def text(self, data: str) -> None: ...

    def comment(self, data: str) -> None: ...

    def read(self, body: str) -> None:
        if "\r" in body:
            body = body.replace("\r\n", "\n").replace("\r", "\n")
        self.body, self.foreign = body.replace("\0", "�"), 0
        at, n = 0, len(self.body)
        while at < n:
            open_ = self.body.find("<", at)
            if open_ != at:
                self.text(unescape(self.body[at : open_ if open_ >= 0 else n]))
            at = n if open_ < 0 else self.markup(open_)

    def markup(self, at: int) -> int:
        """What a < begins; where it ends."""
        body = self.body
        c = body[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            return self.tag(at + 1)
        if c == "/":
            d = body[at + 2 : at + 3]
            if d.isascii() and d.isalpha():
                return self.tag(at + 2, closing=True)
            if d == ">":
                return at + 3
            return self.bogus(at + 2) if d else self.literal("</", len(body))
        if c == "!":
            if body.startswith("--", at + 2):
                return self.whole_comment(at + 4)
            if body[at + 2 : at + 9].lower() == "doctype":
                end = body.find(">", at)
                return len(body) if end < 0 else end + 1
            return self.bogus(at + 2)
        if c == "?":
            return self.bogus(at + 1)
        return self.literal("<", at + 1)

    def literal(self, data: str, to: int) -> int:
        self.text(data)
        return to

    def bogus(self, at: int) -> int:
        end = self.body.find(">", at)
        end = len(self.body) if end < 0 else end
        self.comment(self.body[at:end])
        return end + 1

    def whole_comment(self, at: int) -> int:
        for short in (">", "->"):
            if self.body.startswith(short, at):
                self.comment("")
                return at + len(short)
        m = COMMENT_END.search(self.body, at)
        self.comment(self.body[at : m.start()] if m else re.sub(r"--?!?$", "", self.body[at:]))
        return m.end() if m else len(self.body)

    def tag(self, at: int, closing: bool = False) -> int:
        body, n = self.body, len(self.body)
        m = NAME.match(body, at)
        name, at, attributes = m.group().translate(LOWER), m.end(), {}
        while True:
            at = BETWEEN.match(body, at).end()
            if at >= n:
                return n  # a tag that the page ends in is none
            if body[at] == ">":
                break
            m = ATTRIBUTE.match(body, at)
            key, at, value = m.group().translate(LOWER), BLANKS.match(body, m.end()).end(), ""
            if body.startswith("=", at):
                at = BLANKS.match(body, at + 1).end()
                quote = body[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = body.find(quote, at + 1)
                    if end < 0:
                        return n
                    value, at = body[at + 1 : end], end + 1
                elif quote != ">":
                    m = UNQUOTED.match(body, at)
                    value, at = m.group(), m.end()
            attributes.setdefault(key, attribute_text(value))
        closed = body[at - 1] == "/"
        at += 1
        if closing:
            self.foreign -= name in ("svg", "math") and self.foreign > 0
            self.end(name)
            return at
        if self.foreign and name in BREAK_OUT:
            self.foreign = 0
        self.start(name, attributes)
        if name in ("svg", "math"):
            self.foreign += not closed
        return at if self.foreign else self.content(name, at)

    def content(self, name: str, at: int) -> int:
        """The text of an element whose content has a state of its own; its end tag is read as any other."""
        if name == "script":
            end = self.script_end(at)
        elif name == "plaintext":
            end = len(self.body)
        elif name in WITH_REFERENCES or name in RAW:
            m = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(self.body, at)
            end = m.start() if m else len(self.body)
        else:
            return at
        data = self.body[at:end]
        if data:
            self.text(unescape(data) if name in WITH_REFERENCES else data)
        return end

    def script_end(self, at: int) -> int:
        """Where a script's text ends: at its end tag, unless that is one of a script within a comment within the script."""
        state = 0  # plain, in a comment, in a script in a comment
        while m := SCRIPT_STEP.search(self.body, at):
            at = m.end()
            if m.group() == "-->":
                state = 0
            elif m.group() == "<!--":
                state = state or 1
                at -= 2  # the comment's own dashes may end it
            elif not m.group(1):
                state = 2 if state else 0
            elif state < 2:
                return m.start()
            else:
                state = 1
        return len(self.body)
