"""Pages with known main text; each case is a page and the text it must give."""

import pytest

from screenlens.llm import html

LONG = "The main text of the page goes on here, with commas, and it is long enough to be told from menus. "
CASES = {
    "empty": ("", ""),
    "text": ("just  some\n text &amp; more", "just some text & more"),
    "article": (
        f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';if(a<b){{}}</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &eacute;</h1><p><b>{LONG}<br><p>Second,\n\t paragraph&nbsp;here.</p></article><footer>&copy; us</footer>",
        f"Head é\n{LONG.strip()}\nSecond, paragraph here.",
    ),
    "divs": (
        f"<body><div id=header><h1>Site</h1></div><div class='top-menu'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div id=wrap><div class=col1><h2>Title</h2><p>{LONG}<p>{LONG}{LONG}</div><div class=col2><ul><li><a href=1>Other story one</a></li><li><a href=2>Other story two</a></li></ul></div></div><div class=comments><p>{LONG}</p></div></body>",
        f"Title\n{LONG.strip()}\n{(LONG * 2).strip()}",
    ),
    "forms": (
        f"<main><p>{LONG}</p><form><p>Name, mail, {LONG}</p><input value=x></form><aside>{LONG}</aside><div class='cookie-notice'>{LONG}</div><p hidden>{LONG}</p><p>End.</p><section id='comments'><p>{LONG}</p></section></main>",
        f"{LONG.strip()}\nEnd.",
    ),
    "lists": (
        f"<article><p>{LONG}</p><ul><li>first<li>second <i>one</i></ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre><!-- <p>no</p> --></article>",
        f"{LONG.strip()}\nfirst\nsecond one\na\nb\nc\nx y",
    ),
    "broken": (f"<div><p>{LONG}</div></div></p><<p>a < b</p", f"{LONG.strip()}\n< a < b"),
    "sections": (f"<div id=x><article><header><h1>Head</h1></header><section><p>{LONG * 9}</section><section><p>Short.</section></article><p>{LONG}</div>", f"Head\n{(LONG * 9).strip()}\nShort."),
    "classes": (
        f"<div class='page with-sidebar'><div class='main-content' id=content><h2>T</h2><p>{LONG}</p><div class='entry-share'>Share {LONG}</div><div class='comment-body'><p>{LONG}</p></div><p>{LONG}</p><div class='post-footer'><p>{LONG}</p></div></div><div id=rightSidebar><p>{LONG}</p></div></div>",
        f"T\n{LONG.strip()}\n{LONG.strip()}",
    ),
    "articles": (
        f"<main><h1>News</h1><article><h2>First</h2><p>{LONG * 3}</article><div><article><h2>Second</h2><p>{LONG * 2}<ul><li>point</ul></article></div><article class=teaser><a href=x>Read the other story that is on this site</a></article></main>",
        f"First\n{(LONG * 3).strip()}\nSecond\n{(LONG * 2).strip()}\npoint",
    ),
    "siblings": (
        f"<body><div class=menu><a href=1>One</a></div><div id=wrap><h1>Title</h1><p>By Someone</p><div class=body><p>{LONG * 3}</p><p>{LONG * 3}</p></div><p>Short line</p><ul><li>first thing<li>second thing</ul><blockquote>Quoted words</blockquote><div class=links><a href=1>More</a> <a href=2>Other</a></div><p>Copyright 2020 Some Body</p></div></body>",
        f"Title\nBy Someone\n{(LONG * 3).strip()}\n{(LONG * 3).strip()}\nShort line\nfirst thing\nsecond thing\nQuoted words",
    ),
    "nested": (f"<article><h1>Head</h1><p>{LONG * 3}</p><article><h2>Part</h2><p>{LONG}</p></article></article>", f"Head\n{(LONG * 3).strip()}\nPart\n{LONG.strip()}"),
    "plain": (f"<table><tr><td><a href=1>One</a> <a href=2>Two</a><td>{LONG * 4}<br><br>More of it, and the end.</table>", None),
    "deep": ("<div>" * 5000 + f"<p>{LONG}</p>", LONG.strip()),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    page, want = CASES[name]
    got = html.extract(page)
    if name == "plain":
        assert (LONG * 4).strip() in got and "Two" not in got.split("The main")[-1]
    elif name == "broken":  # only that nothing fails and that no text is lost
        assert LONG.strip() in got
    else:
        assert got == want


def test_query(spark):
    rows = [(i, f"http://x/{i}", page) for i, (page, _) in enumerate(CASES.values())] + [(None, None, None), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")
    got = {(r.page_id, r.url): r for r in html.extract_pages(spark, pages).collect()}
    assert got[(None, None)].text == "" and got[(None, None)].n_chars == 0
    for i, (name, (_, want)) in enumerate(CASES.items()):
        if name not in ("broken", "plain"):
            assert got[(i, f"http://x/{i}")].text == want and got[(i, f"http://x/{i}")].n_chars == len(want)
    assert html.extract_pages(spark, pages.limit(0)).count() == 0
