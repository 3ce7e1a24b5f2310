import random
from html.parser import HTMLParser

import pytest
from tickweave.llm.layout import extract_text, visible_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain  &amp; text\n", "plain & text"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<html><head><title>T</title><style>p{}</style></head><body><h1>H</h1>a<br>b<script>var x='</p>'</script></body></html>", "H\n\na\nb"),
    ("<title>no head<p>x", ""),
    ("<ul><li>a<li>b<ol><li>c</ol><li>d</ul>end", "- a\n- b\n  1. c\n- d\n\nend"),
    ("<p hidden>x</p><p style='color:red; Display : none'>y</p><span style=visibility:hidden>z</span>w<template>q</template>", "w"),
    ("<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>longer name<td>1<tr><td colspan=2>wide</table>after", "Cap\nName         N\nlonger name  1\nwide\n\nafter"),
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a  b\n   c"),
    ("<pre>a\n  b &lt;</pre>c", "a\n  b <\n\nc"),
    ("<dl><dt>term<dd>meaning<dt>two<dd>more</dl>", "term\n  meaning\ntwo\n  more"),
    ("<details><summary>s</summary>gone</details><details open><summary>s</summary>here</details>", "s\ns\nhere"),
    ("<b>bo</b>ld <a href='x>y'>link</a><!-- a > b -->!", "bold link!"),
    ("a < b and <3 <unknown>x</unknown></p></div>", "a < b and <3 x"),
    ("<blockquote>q<p>r</blockquote>s", "> q\n\n> r\n\ns"),
    ("<div><p>a</div>b", "a\n\nb"),
    ("x<!-- never closed", "x"),
    ("<img alt='pic'><input type=hidden value=v><input type=submit value=Go>", "picGo"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendering(html, text):
    assert visible_text(html) == text


class Words(HTMLParser):
    """All words outside hidden elements, by another parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")

    def handle_data(self, data):
        self.words += data.split() * (not self.skip)


def test_no_visible_word_is_lost():
    rng = random.Random(3)
    for _ in range(200):
        out, k = ["<html><head><title>t</title></head><body>"], 0
        for _ in range(rng.randrange(1, 40)):
            k += 1
            out.append(rng.choice(["<p>w{}</p>", "<p>w{}", "<li>w{}", "<ul><li>w{}</ul>", "<table><tr><td>w{}<td>x</table>", "<div><b>w{}</b></div>", "<script>w{}</script> ", "w{} ", "<h2>w{}</h2>", "<pre>w{}\n y</pre>", "<br>w{} "]).format(k))
        page = "".join(out) + "</body></html>"
        words = Words()
        words.feed(page)
        got = [w for w in visible_text(page).split() if w not in ("-",)]
        assert got == words.words, page


def test_deep_nesting_and_frames(spark):
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert visible_text(deep) == "x" and visible_text("<table><tr><td>" * 300 + "y").strip() == "y"
    df = spark.createDataFrame([(1, None, 1), (1, "<p>a", 2), (None, "<p>a", 3)], "page_id long, html string, text int")
    assert sorted(map(tuple, extract_text(df).collect()), key=str) == sorted([(1, "", 0), (1, "a", 1), (None, "a", 1)], key=str)
    assert extract_text(df.limit(0)).count() == 0
