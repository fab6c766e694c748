"""Main text of small pages."""

import re
from html import unescape

import pytest

from plumbline.llm.html import extract, main_blocks

LONG = "A paragraph with some length, commas, and a point that it makes at the end"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>No</title>{head}</head><body>{body}</body></html>"


CASES = [
    (page(f"<nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Title</h1><p>{LONG} one.<p>{LONG} &amp;amp; two.</article><footer>&copy; x</footer>"),
     ["Title", LONG + " one.", LONG + " &amp; two."]),
    (page(f"<div class='sidebar'><p>{LONG}</p></div><div id='content'><h2>Head</h2><p>{LONG}.</p><p>Short.</p><p>{LONG}!</p></div><div class='comments'><p>{LONG}</p></div>"),
     ["Head", LONG + ".", "Short.", LONG + "!"]),
    (page(f"<div><div class=\"ad\">Buy, buy, buy this thing now for less</div><div class='post-body'>{LONG}<br>next  line</div></div>"), [LONG + " next line"]),
    (page(f"<main><article><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p><ul><li>First item</li><li>Second</li></ul>"
          f"<form><input name=q><p>{LONG}</p></form><aside><p>{LONG}</p></aside></article><section class='related'><p>{LONG}</p></section></main>"),
     [LONG, "First item", "Second"]),
    (page(f"<article><p><b>{LONG}<br><p>{LONG} two</p></article>"), [LONG, LONG + " two"]),
    (page(f"<header><h1>Site</h1></header><article><header><h1>Story</h1></header><div><p>{LONG}</p></div><div><p>{LONG} b</p></div></article>"), ["Story", LONG, LONG + " b"]),
    (page("<article><p>Hi.</p></article>"), ["Hi."]),
    ("just text", ["just text"]),
    (page("<table><tr><td>" + LONG + "<td>" + LONG + " 2</table>"), [LONG, LONG + " 2"]),
    ("", []), (None, []), ("<p", ["<p"]), ("<script>x", []),
]


FOUR = "".join(f"<p>{LONG} {k}.</p>" for k in range(4))
NAMED = [
    f"<div class='layout has-sidebar'>{FOUR}</div><div class='links'><p>Short.</p></div>",
    f"<div class='no-sidebar'><div class='sidebar'><p>{LONG}</p></div><div>{FOUR}</div></div>",
    f"<article class='post comments-open'>{FOUR}</article><div class='comments'><article class='comment-body'><p>{LONG}</p></article></div>",
    f"<div class='elementor-widget-container'>{FOUR}</div>",
    f"<div class='social-layout'><main>{FOUR}</main></div><section class='related'><article><p>{LONG}</p></article></section>",
]


@pytest.mark.parametrize("body", NAMED)
def test_names_of_wrappers_do_not_remove_the_article(body):
    assert main_blocks(page(body)) == [f"{LONG} {k}." for k in range(4)]


def test_a_page_of_named_boxes_is_not_empty():
    assert main_blocks(page(f"<div class='widget'><p>{LONG} 0</p></div><div class='widget'><p>{LONG} 1</p></div>")) == [f"{LONG} 0", f"{LONG} 1"]


@pytest.mark.parametrize("source,blocks", CASES)
def test_cases(source, blocks):
    assert main_blocks(source) == blocks


def test_given_pages_keep_the_article_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text.split("\n\n") == [x for x in want if x] and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<div>" * 30_000 + LONG), (2, "v", "x"), (2, "v", "x"), (3, "w", "<p>" + "a, " * 100_000 + "&nbsp;é&#x1F600;</p>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.text[-30:], r.n_chars) for r in extract(df).collect()), key=str)
    assert (2, LONG[-30:], len(LONG)) in got and got.count((2, "x", 1)) == 2 and (1, "", 0) in got and (None, "", 0) in got
    assert any(r[0] == 3 and r[1].endswith("a, é😀") for r in got)
    assert extract(df.limit(0)).collect() == []
