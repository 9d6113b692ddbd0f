"""Tokenizer states: titles, attributes, scripts, comments and raw text, and what the page extraction makes of them."""

import pytest

from webstrata.functions.html import parse
from webstrata.functions.markup import Tokenizer


class Events(Tokenizer):
    def __init__(self, body):
        self.out = []
        self.read(body)

    def start(self, tag, attributes):
        self.out.append((tag, attributes))

    def end(self, tag):
        self.out.append("/" + tag)

    def text(self, data):
        if self.out and isinstance(self.out[-1], list):
            self.out[-1][0] += data
        else:
            self.out.append([data])

    def comment(self, data):
        self.out.append(("!", data))


@pytest.mark.parametrize(
    ("body", "title"),
    [
        ("<html><head><title>Our Shop</title></head><body></body></html>", "Our Shop"), ("<title>\n    Our Shop\n  </title>", "Our Shop"), ("<title>Salt &amp; Pepper &lt;Shop&gt;</title>", "Salt & Pepper <Shop>"), ("<title></title>", ""), ("<html><head></head></html>", ""),
        ("<title>one</title><title>two</title>", "one"), ("<title><!-- stays --> as it is</title>", "<!-- stays --> as it is"), ("<title>a <b>bold</b> move</title>", "a <b>bold</b> move"), ("<TITLE>x</TiTlE >y", "x"), ("<title>no end", "no end"),
        ("<title>a</titles></title>", "a</titles>"), ("<textarea><title>no</title></textarea><title>yes</title>", "yes"), ("<style><title>no</title></style><title>yes</title>", "yes"), ("<script>'<title>no</title>'</script><title>yes</title>", "yes"), ("<!-- <title>no</title> --><title>yes</title>", "yes"),
        ("<title>1 &lt 2 &copy 3 &#x41;&#66;</title>", "1 < 2 © 3 AB"), ("<title>\r\na\rb</title>", "a\nb"),
    ],
)
def test_titles(body, title):
    assert parse(body)["title"] == title


@pytest.mark.parametrize(
    ("tag", "attributes"),
    [
        ("<a href=x>", {"href": "x"}), ("<a HREF = 'x y' href=z>", {"href": "x y"}), ('<a href="a>b" b>', {"href": "a>b", "b": ""}), ("<a/href=x/>", {"href": "x/"}), ("<a =b=c>", {"=b": "c"}), ("<a b= >", {"b": ""}), ("<a b=>", {"b": ""}), ("<a\nb\t=\f'1'c=2>", {"b": "1", "c": "2"}),
        ("<a x='&amp;&copy=1&copy;&copyx&notit;&#65&#x42;' y=&lt>", {"x": "&&copy=1©&copyx&notit;AB", "y": "<"}), ('<a "b"=c>', {'"b"': "c"}), ("<a b='c'/d>", {"b": "c", "d": ""}), ("<a x=\"'\" y='\"'>", {"x": "'", "y": '"'}),
    ],
)
def test_attributes(tag, attributes):
    assert Events(tag).out == [("a", attributes)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("a<b", [["a"]]), ("<a href='x", []), ("a < b <3", [["a < b <3"]]), ("</>x</ y>", [["x"], ("!", " y")]), ("<?php x ?>y", [("!", "?php x ?"), ["y"]]), ("<!DOCTYPE html>x", [["x"]]), ("<![CDATA[x]]>", [("!", "[CDATA[x]]")]), ("x</", [["x</"]]),
        ("<!-->a<!--->b<!---->c", [("!", ""), ["a"], ("!", ""), ["b"], ("!", ""), ["c"]]), ("<!--a--!>b", [("!", "a"), ["b"]]), ("<!-- a -- b --->c", [("!", " a -- b -"), ["c"]]), ("<!--open", [("!", "open")]), ("<b>x</B c=d>", [("b", {}), ["x"], "/b"]),
        ("<style>a</b><!-- </style>c", [("style", {}), ["a</b><!-- "], "/style", ["c"]]), ("<noscript><a href=x></noscript>", [("noscript", {}), ["<a href=x>"], "/noscript"]), ("<plaintext><b>&amp;", [("plaintext", {}), ["<b>&amp;"]]), ("<iframe><title>x</title></iframe>", [("iframe", {}), ["<title>x</title>"], "/iframe"]),
        ("<svg><title>a<b>", [("svg", {}), ("title", {}), ["a"], ("b", {})]), ("<svg/><title>a<b></title>", [("svg", {}), ("title", {}), ["a<b>"], "/title"]), ("<svg><style><a></style></svg><style><a></style>", [("svg", {}), ("style", {}), ("a", {}), "/style", "/svg", ("style", {}), ["<a>"], "/style"]),
        ("\0a", [["�a"]]), ("&amp;&nosuch;", [["&&nosuch;"]]),
    ],
)
def test_states(body, want):
    assert Events(body).out == want


@pytest.mark.parametrize(
    ("script", "inline"),
    [
        ("var a='</p>';", "var a='</p>';"), ("<!-- x --> y", "<!-- x --> y"), ("<!-- <script> </script> --> z", "<!-- <script> </script> --> z"), ("'</scripts>'", "'</scripts>'"), ("<!-- <script> --> a", "<!-- <script> --> a"),
        ("<!--> <script> b", "<!--> <script> b"), ("a && b &amp; c", "a && b &amp; c"), ("<!-- <scripted> q", "<!-- <scripted> q"),
    ],
)
def test_scripts(script, inline):
    """The text of a script up to its end tag, and what follows it is markup again."""
    page = parse(f"<script>{script}</script><title>after</title>")
    assert page["inline_script"] == inline and page["title"] == "after"


def test_scripts_that_hide_their_end():
    page = parse("<script><!-- <script> </script> x</script><title>in</title>")
    assert page["title"] == "in" and page["inline_script"] == "<!-- <script> </script> x"
    assert parse("<script><!-- <script> x</script><title>hidden</title>")["title"] == ""
    assert parse("<script src=/a.js></script ><SCRIPT SRC='/b.js'/></script><script>x")["script_sources"] == ["/a.js", "/b.js"]


def test_long_pages_are_read_in_jumps():
    body = "<p>" + "<" * 200_000 + "</p>" + "<!--" + "-" * 200_000 + "<a " + "b " * 100_000
    assert parse(body)["title"] == ""
