import random
import time

import pytest
from tickweave.llm.layout import visible_text

CASES = [
    ("<table><tbody><td>x</table>", "x"),
    ("<table><tbody>loose<tr><td>x</table>", "loose\nx"),
    ("<table><tbody><form><tr><td>x<td>y</form></table>", "x  y"),
    ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><tbody><div>moved</div><tr><td>x</table>", "moved\nx"),
    ("<math><mi>x</mi></math> <svg><title>t</title><text>drawn</text></svg>", "x drawn"),
    ("<textarea>typed</textarea>", "typed"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<dialog open>seen</dialog><dialog>unseen</dialog>", "seen"),
    ("<head><title>t</title>Hello <b>x</b>", "Hello x"),
    ("<head><title>t</title><b>x</b> y", "x y"),
    ("<head> <meta charset=utf-8> <script>s</script> <link rel=x></head>z", "z"),
    ("<noscript>n</noscript><datalist><option>o</datalist>v", "v"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_what_browsers_show_is_kept(html, text):
    assert visible_text(html) == text


TAGS = [
    ("<p><a href=x title=it's>Hello</a> <b>don't</b> ok", "Hello don't ok"),
    ("<object>instead</object>x", "insteadx"),
    ("<p style=visibility:hidden>a <b style='visibility:visible'>b</b> c</p>", "b"),
    ("<style>.x{display:none} /* .c{display:none} */ #q, p.y {visibility:hidden} @media print{.z{display:none}}</style><p class='a x'>n<p class=y>n<p class=z>yes<p id=q>n<p class=c>c", "yes\n\nc"),
    ("<style>.x{display:none} b.x{display:inline} .i{display:none !important}</style><i class=x>n</i><b class=x>y</b><u class=i style=display:block>n</u><u class=x style=display:inline>z</u>", "yz"),
    ("<style>.x>b, a:hover, [c]{display:none}</style><b>kept</b>", "kept"),
    ("<div hidden style='display:block'>shown</div>", "shown"),
    ("<svg><path d=x /><text>t</text><![CDATA[a<b]]></svg>after", "ta<bafter"),
    ("x<!-->y<!--->z<!-- q --!>w</ >v<?php u?>t", "xyzwvt"),
    ("</>a<>b", "a<>b"),
    ("<a/b=c>a</a /><a b = 'c>d' e>f</a><a =x>g", "afg"),
    ("x<a title='never closed>z</a>", "x"),
    ("x<script>s</scripty></SCRIPT >z<textarea></b></textarea>", "xz</b>"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=3>over all of them<tr><td>a<td>b<td>c</table>", "over all of them\na  b  c"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
    ("<table><tr style=visibility:collapse><td>n<td style=visibility:visible>y</table>", "  y"),
]


@pytest.mark.parametrize("html,text", TAGS)
def test_tags_and_rules(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<a " * 100_000, "<a href='" * 50_000, "<!--" * 100_000, "<script>" * 50_000, "<table><tr><td rowspan=100 colspan=100>" * 1000, "<table>" + "<tr><td rowspan=60000>x<td>y" * 5000, "<table><tr>" + "<td>x" * 20_000],
)
def test_hostile_pages_take_linear_time(html):
    start = time.time()
    assert len(visible_text(html)) < len(html)
    assert time.time() - start < 5


def test_padding_is_bounded():
    page = "<table><tr>" + f"<td>{'w' * 150}" * 100 + "<tr><td colspan=99><td>x" * 3000
    assert visible_text(page).count("x") == 3000 and len(visible_text(page)) < 40 * len(page)


def brute(node):
    """(html, words seen) of a tree: tag, attributes, hidden, children."""
    if isinstance(node, str):
        return node + " ", [node]
    tag, attributes, shown, children = node
    inner = [brute(c) for c in children]
    words = [w for _, ws in inner for w in ws] if shown else []
    return f"<{tag}{attributes}>" + "".join(h for h, _ in inner) + ("" if tag in ("p", "li", "td", "tr") else f"</{tag}>"), words


def test_no_word_of_a_random_tree_is_lost():
    rng, number = random.Random(11), 0

    def made(depth, inline=False):
        nonlocal number
        number += 1
        if depth == 0 or rng.random() < 0.25:
            return f"w{number}"
        kinds = ["b", "i", "span"] if inline else ["div", "section", "ul", "table", "b", "blockquote", "p"]
        tag = rng.choice(kinds)
        hidden = rng.random() < 0.1 and tag in ("div", "section", "b", "span", "i", "table")
        attributes = rng.choice([" hidden", " style='display:none'", " class=gone"]) if hidden else ""
        some = lambda f: [f() for _ in range(rng.randrange(1, 4))]
        if tag == "table":
            cell = lambda: ("td", f" colspan={rng.randrange(1, 4)} rowspan={rng.randrange(1, 3)}", True, some(lambda: made(depth - 1)))
            return tag, attributes, not hidden, some(lambda: ("tr", "", True, some(cell)))
        if tag == "ul":
            return tag, attributes, not hidden, some(lambda: ("li", "", True, some(lambda: made(depth - 1))))
        return tag, attributes, not hidden, some(lambda: made(depth - 1, inline or tag in ("b", "p", "i", "span")))

    for _ in range(300):
        pages, words = zip(*(brute(made(4)) for _ in range(3)), strict=True)
        html = "<style>.gone{display:none}</style>" + "".join(pages)
        got = [w for w in visible_text(html).split() if w not in ("-", ">")]
        want = [w for ws in words for w in ws]
        assert sorted(got) == sorted(want), html
        if "<table" not in html:
            assert got == want, html


def test_end_tags_of_deep_elements_end_no_ancestor():
    deep = "<div hidden>" + "<div>" * 250 + "</div>" * 201 + "SECRET" + "</div>" * 49 + "SECRET</div>shown"
    assert visible_text(deep).strip() == "shown"
    spans = "<div hidden>" + "<span><b>" * 400 + "</b></span>" * 399 + "SECRET</div>shown"
    assert visible_text(spans).strip() == "shown"
    stray = "<div hidden>" + "<div>" * 250 + "</p></table></div>" * 250 + "SECRET</div>shown"
    assert "SECRET" not in visible_text(stray) and "shown" in visible_text(stray)


def test_many_comments_take_linear_time():
    start = time.time()
    assert visible_text("<!---->" * 100_000 + "a<!-- x --!>b<!-- y -->c<!-->d").strip() == "abcd"
    assert time.time() - start < 3
