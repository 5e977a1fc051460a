"""Main text of pages: layouts written out, and the given pages against their construction."""

import html
import re
import time

import pytest
from llm_helpers import rows_of

from tabquest.llm import html_text

P1 = "The river rose again last night, and people moved their boats to higher ground before morning."
P2 = "Nobody was hurt. The mayor said, however, that two bridges stay closed until the weekend."
P3 = "Short one."

LAYOUTS = {
    "article": f"<nav><a href=/>Home</a></nav><article><h1>Flood</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><footer>&copy; us</footer>",
    "divs": f"<div class='site-header'>The Daily. News, all day.</div><div id=content><h2>Flood</h2><p>{P1}<p>{P2}<p>{P3}</div>"
    f"<div class=sidebar><p>{P2} Read more, now!</p></div>",
    "main": f"<header><h1>The Daily</h1><ul><li><a>News</a><li><a>Sport</a></ul></header><main><h1>Flood</h1><p>{P1}</p><aside>{P2}</aside>"
    f"<p>{P2}</p><p>{P3}</p></main>",
    "notices": f"<div class='cookie-notice'>We use cookies. You can, of course, say no.</div><article><h1>Flood</h1><p>{P1}</p>"
    f"<form><p>Sign up, please.</p><input></form><div class='ad-slot ad'>Buy. Now, cheap.</div><p>{P2}</p><p>{P3}</p>"
    f"<section class='comments'><p>{P1} First!</p></section></article>",
    "comments after": f"<article><h1>Flood</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><div id='comments'><div class='comment'>{P1}</div></div>",
    "inline": f"<article><h1>Fl<b>oo</b>d</h1><p>{P1[:20]}<i>{P1[20:40]}</i>{P1[40:]}</p><p>{P2}</p><p>{P3}</p>"
    "<script>var x = '<p>no, never.</p>';</script><style>p{}</style><!-- no, <p>never</p> --></article>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{LAYOUTS[name]}</body></html>"
    assert html_text.main_text(page) == f"Flood {P1} {P2} {P3}"


@pytest.mark.parametrize("n", [1, 6, 19, 184])
def test_blocks_of_any_tag_inside_long_articles(n):
    lead, quote, note = "The town held its breath", "We were lucky, they said.", "Photo of the bridge"
    rest = [f"{P1} {P2}"] * n
    page = f"<article><h1>Flood</h1><div class=lead>{lead}</div><p>{'</p><p>'.join(rest)}</p><section>{quote}</section><figure>{note}</figure>"
    menu = "<div><a href=/>Back to the list</a></div>"
    text = " ".join(["Flood", lead, *rest, quote, note])
    assert html_text.main_text(f"<html><body>{page}{menu}</article></body></html>") == text
    unmarked = page.replace("<article>", "<div class=text>")
    assert html_text.main_text(f"<html><body>{unmarked}{menu}</div><div>All rights kept</div></body></html>") == text


LONG = [f"{P1} {P2}", P2, f"{P1} It will, they say, be a long winter.", P3, f"{P2} {P1}", P1]
BODY = "".join(f"<p>{p}</p>" for p in LONG)
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/s>Sport, and more</a></li></ul>"
NOTICE = "We use cookies. You can, of course, say no."
# Layouts whose content does not depend on a name: the text must be the same with and without classes and ids.
NAMELESS = {
    "page": f"<div id=page><div class=top>The Daily</div><div class=menu>{MENU}</div><div class=body><h1>Flood</h1>{BODY}</div><div class=note>{NOTICE}</div></div>",
    "notice first": f"<div class=cookie-notice>{NOTICE} <a>Yes</a> <a>No</a></div><div id=content><h2>Flood</h2>{BODY}</div>",
    "notice last": f"<div id=content><h2>Flood</h2>{BODY}</div><div class=notice><p>{NOTICE}</p></div>",
    "headline outside": f"<div class=page>{MENU}<h1 class=title>Flood</h1><div class=entry>{BODY}</div><div class=copyright>All rights kept</div></div>",
    "words for a menu": f"<div class=nav><span>Home</span> <span>Sport</span> <span>Weather</span></div><div class=x><h1>Flood</h1>{BODY}</div>",
    "sections": "<div class=a><h1>Flood</h1>" + "".join(f"<div class=s><p>{p}</p></div>" for p in LONG) + f"</div><div class=share>{MENU}</div>",
    "table": f"<table><tr><td class=menu>{MENU}</td><td class=text><h1>Flood</h1>{BODY}</td><td class=ad>Buy. Now, cheap.</td></tr></table>",
    "breaks": f"<div class=bar>{MENU}</div><div class=text><h1>Flood</h1>{'<br><br>'.join(LONG)}</div><div class=foot>All rights kept. Us, 2024.</div>",
    "article": f"<div class=ad>Buy. Now, cheap.</div><article class=post><h1>Flood</h1>{BODY}</article><div class=related><p>{P2}</p></div>",
    "links inside": f"<div class=text><h1>Flood</h1>{BODY}<div class=tags>{MENU}</div></div><div class=side><ul><li>Today</li><li>Week</li></ul></div>",
    "paragraphs": f"<div class=bar>{MENU}</div><h1>Flood</h1>{BODY}<div class=foot><span>All rights kept</span></div>",
}


def nameless(page):
    return re.sub(r"\s(?:class|id)=(?:\"[^\"]*\"|[^\s>]*)", "", page)


@pytest.mark.parametrize("name", list(NAMELESS))
def test_ratios_decide_without_names(name):
    page = f"<html><body>{NAMELESS[name]}</body></html>"
    assert html_text.main_text(page) == f"Flood {' '.join(LONG)}"
    assert html_text.main_text(nameless(page)) == f"Flood {' '.join(LONG)}"


def test_given_pages_without_names(given):
    for r in rows_of(given("pages")):
        assert html_text.main_text(nameless(r["html"])) == plain(r["html"])


def test_names_of_wrappers_and_paragraphs():
    article = f"<article><h1>Flood</h1>{BODY}</article>"
    text = f"Flood {' '.join(LONG)}"
    foot = "<footer>All rights kept, us.</footer>"
    for open_tag, close_tag in (
        ('<div class="container has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="sidebar-layout widget">', "</div>"),
        ('<div class="search"><div id="print"><div class="page-with-comments">', "</div></div></div>"),
    ):
        assert html_text.main_text(f"<body>{open_tag}{article}{foot}{close_tag}{foot}</body>") == text
    assert html_text.main_text(f'<body><div id="no-sidebar"><h1>Flood</h1>{BODY}</div>{foot}</body>') == text
    assert html_text.main_text(f'<body><div class="widget-area"><h1>Flood</h1>{BODY}</div>{foot}</body>') == text
    assert html_text.main_text(f'<main><p>Intro, short.</p><div class="print-content"><p>{P1}</p></div></main>') == f"Intro, short. {P1}"
    assert html_text.main_text(f'<article><p class="social">{P1}</p><p>{P2}</p></article>') == f"{P1} {P2}"
    assert html_text.main_text(f'<article><h2 class="notice-title">Flood</h2><p>{P2}</p></article>') == f"Flood {P2}"
    # more comments than article, with articles of their own
    many = "".join(f'<article class="comment"><p>{P1} First!</p></article>' for _ in range(40))
    assert html_text.main_text(f'<body>{article}<section id="comments">{many}</section></body>') == text
    assert html_text.main_text(f'<body><div class=text><h1>Flood</h1>{BODY}</div><div class="comments">{many}</div></body>') == text


def test_unclosed_quotes_and_deep_pages_take_linear_time():
    assert html_text.main_text('<p title="abc>text, x</p>') == "text, x"
    assert html_text.main_text("<p title='a>b'>One, two.</p><p title='>Three, four.</p>") == "One, two. Three, four."
    n = 100_000
    pages = ["<div>" * n + "x, y.", '<div class="sidebar">' * n + "x", "<div>x" * n, "<blockquote>x, y." * n, "</div>" * n, "<div>" * n + "</p>" * n]
    pages += ["<b>" * n + "</i>" * n, "<a \"'>" * n + "'", "<ul><li>x" * n, "<" * n, "<p>x, y.</p>" * n, "<span class=ad>x" * n]
    for page in pages:
        started = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - started < 6, page[:30]


def test_unmarked_text_beside_a_marked_teaser():
    page = f"<html><body><div id=text><h1>Flood</h1><p>{P1}</p><p>{P2}</p></div><article><p>See it</p></article></body></html>"
    assert html_text.main_text(page) == f"Flood {P1} {P2}"


def test_references_and_white_space():
    page = "<article><p>A &amp; B&nbsp;&#8211;\n\n  C &lt;d&gt;,\t e &copy x.<br>F</p><p>G, h.</p></article>"
    assert html_text.main_text(page) == "A & B – C <d>, e © x. F G, h."


def test_broken_and_odd_pages():
    for page in ("", "<", "<p", "</p>", "<p>", "<a b='", "<!--", "<script>", "a < b", "<<<>>>", "<p>" * 3000 + "x", "<b>" * 5000, "\x00"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("<article><p>One, two.</article><p>") == "One, two."
    assert html_text.main_text("<p>One, two.<p>Three, four.") == "One, two. Three, four."
    assert html_text.main_text("plain text only, without tags.") == "plain text only, without tags."


def plain(page):
    """The article element of the given pages, whose layout is one and the same."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_given_pages(given):
    pages = {r["page_id"]: r for r in rows_of(given("pages"))}
    found = rows_of(html_text.extract(given("pages")))
    assert len(found) == len(pages)
    for r in found:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == plain(pages[r["page_id"]]["html"])


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "t", "n"), (None, None, "", None, None), (1, "u", "<p>A, b.</p>", "t", "n"), (1, "u", "<p>A, b.</p>", "t", "n")]
    found = rows_of(html_text.extract(spark.createDataFrame(rows, schema)))
    assert sorted(r["text"] for r in found) == ["", "", "A, b.", "A, b."]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
