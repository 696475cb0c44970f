import random
import re
from html.parser import HTMLParser

import pytest

from phrasewell.llm.html_text import extract, visible_text

CASES = {
    "implied end tags": ("<p>one<p>two<ul><li>a<li>b</ul><dl><dt>t<dd>d</dl>", "one\n\ntwo\n\n- a\n- b\n\nt\n  d"),
    "nested lists": ("<ol start=3><li>x<ul><li>y</ul><li>z</ol>", "3. x\n   - y\n4. z"),
    "table": ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name      | N\nlong name | 1"),
    "colspan": ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"),
    "rowspan": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d<tr><td>e<td>f</table>", "a | b\n  | c | d\ne | f"),
    "rowspan, colspan": ("<table><tr><td rowspan=2 colspan=2>ab<td>x<tr><td>y<tr><td>1<td>2<td>3</table>", "ab |   | x\n   |   | y\n1  | 2 | 3"),
    "blocks in cells": ("<table><tr><td><p>a</p><p>long b</p><td><ul><li>x<li>y</ul><tr><td>c<td>d</table>", "a      | - x\nlong b | - y\nc      | d"),
    "table in a cell": ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>long<td>z</table><tr><td>b<td>c</table>", "a | x    | y\n  | long | z\nb | c"),
    "item values": ("<ol><li>a<li value=7>b<li>c</ol><ol type=a start=26><li>x<li>y</ol><ol type=I reversed><li>p<li>q</ol>", "1. a\n7. b\n8. c\n\nz. x\naa. y\n\nII. p\nI. q"),
    "visible in hidden": ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b><table><tr><td>c<td style='visibility:visible'>d</table></div>", "b\n\n | d"),
    "select and svg": ("<select><option>a<option selected>b</select> <select multiple><option>c<option>d</select><svg><title>t</title>x<text>y</text></svg>", "b\nc\nd\ny"),
    "implied rows": ("<table><td>a<td>b</table>", "a | b"),
    "hidden": ("a<span hidden>b</span><i style='display: none'>c</i><b aria-hidden=true>d</b><u style='visibility:hidden'>e</u>f", "af"),
    "unseen": ("<head><title>t</title><style>x{}</style></head><script>var a='</p>';</script><noscript>n</noscript>text<!-- no -->", "text"),
    "references": ("a &amp; b &lt;c&gt; &#233;&nbsp;d", "a & b <c> é d"),
    "white space": ("  a \n b<b> c </b>d<br>e", "a b c d\ne"),
    "pre": ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    "image, rule": ("<img alt='an image'><hr>x", "an image\n\n---\n\nx"),
    "stray end tags": ("</div>a</p>b</b></table>c", "a\n\nbc"),
    "less-than is text": ("1 < 2 and <3", "1 < 2 and <3"),
    "unclosed": ("<div><b>a", "a"),
    "quotes": ('<p title="a > b">x</p>', "x"),
    "nothing": ("", ""),
    "nothing visible": ("<div> </div>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_rendering(name):
    page, want = CASES[name]
    assert extract(page) == want


class Walker(HTMLParser):
    """Another reading of well-formed pages: the words of all text that is shown, in order."""

    def __init__(self):
        super().__init__()
        self.stack, self.words = [(True, True)], []  # (in the page at all, visible)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("br", "hr"):
            return
        if tag == "img":
            return self.handle_data(a.get("alt") or "")
        there, seen = self.stack[-1]
        style = (a.get("style") or "").replace(" ", "")
        there = there and tag not in ("script", "style", "template") and "hidden" not in a and "display:none" not in style
        seen = "visibility:visible" in style or seen and "visibility:hidden" not in style
        self.stack.append((there, seen))

    def handle_endtag(self, tag):
        if tag not in ("br", "hr", "img"):
            self.stack.pop()

    def handle_data(self, data):
        if all(self.stack[-1]):
            self.words += data.split()


def page(rng, depth=0):
    """A random well-formed element of unlike words."""
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    tag = rng.choice(["div", "p", "span", "b", "ul", "ol", "table", "pre", "script", "h2", "section", "blockquote", "img"])
    extra = rng.choice([""] * 6 + [" hidden", " style='display:none'", " style='visibility: hidden'", " style='visibility:visible'", " class=x"])
    if tag == "img":
        return f"<img alt='{word()}'>"
    if depth > 4 or tag in ("p", "span", "b", "script", "pre", "h2"):
        return f"<{tag if tag in ('p', 'span', 'b', 'script', 'pre', 'h2') else 'p'}{extra}>{word()} {word()}</{tag if tag in ('p', 'span', 'b', 'script', 'pre', 'h2') else 'p'}>"
    inner = lambda: rng.choice([word(), page(rng, depth + 1), word() + page(rng, depth + 1) + word()])
    if tag in ("ul", "ol"):
        return f"<{tag}{extra}>" + "".join(f"<li>{inner()}</li>" for _ in range(rng.randint(1, 3))) + f"</{tag}>"
    if tag == "table":  # one cell in a row has several lines at most: lines of cells side by side aren't in the page's order
        cell = lambda: rng.choice([word(), f"<b>{word()}</b> {word()}"])
        rows = [f"<tr><td>{inner()}</td></tr>", f"<tr><td{extra}>{cell()}</td><td>{cell()}</td></tr>"]
        return f"<table{extra}><tbody>" + "".join(rng.choice(rows) for _ in range(rng.randint(1, 3))) + "</tbody></table>"
    return f"<{tag}{extra}>" + " ".join(inner() for _ in range(rng.randint(1, 3))) + f"</{tag}>"


def test_words_equal_another_reading():
    rng = random.Random(7)
    seen = 0
    for _ in range(400):
        html = f"<body>{page(rng)} {page(rng)}</body>"
        walker = Walker()
        walker.feed(html)
        walker.close()
        got = re.findall("[a-h]{6}", extract(html))
        want = re.findall("[a-h]{6}", " ".join(walker.words))
        assert got == want, html
        seen += len(got)
    assert seen > 1500


def test_null_and_depth():
    assert extract(None) is None
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert extract("<table><tr><td>" * 200 + "deep") == "deep"
    assert len(extract("<p>word</p>" * 20_000).split()) == 20_000


def test_table_of_pages(spark, documents):
    pages = documents([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "u", "")], "page_id bigint, url string, html string", True)
    assert sorted(map(tuple, visible_text(pages).collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, None), (2, "")], key=str)
    assert visible_text(pages.limit(0)).collect() == []
