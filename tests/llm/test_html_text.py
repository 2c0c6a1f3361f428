"""Main text of pages that the labelled table doesn't have, the given pages against a plain cut, and odd markup."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text

SCHEMA = "page_id string, url string, html string, text string, blocks int"
LONG = "The tide came in over the flats and the boats that had lain on their sides all morning began to stir again"

#: Pages and their main text.
HELD_OUT = (
    (f"<header class=site><a href=/>Home</a><h1>Site</h1></header><article><h1>Title &amp; more</h1><p>{LONG}<p>Short.<p>{LONG}</article><footer>Imprint</footer>", f"Title & more\n{LONG}\nShort.\n{LONG}"),
    (f"<div id='nav-main'><a>A</a><a>B</a></div><div class='post'><h2>T</h2><p>{LONG}</p><p>Yes.</p><blockquote>{LONG}</blockquote></div><div id=comments><p>{LONG}</p></div>", f"T\n{LONG}\nYes.\n{LONG}"),
    (f"<body><main><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>Your mail</p><button>Go</button></form><p>End.</p></main><div class='cookie-banner'>{LONG}</div>", f"{LONG}\nEnd."),
    (f"<article><p>{LONG}</p><section class='comments-area'><article class='comment depth-1'><p>{LONG}</p></article></section></article>", LONG),
    (f"<table><tr><td><a>x</a><td><a>y</a></table><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class=ads>{LONG}</div>", "\n".join([LONG] * 3)),
    (f"<article><ul><li>one<li>two<li>{LONG}</ul><p>see <a href='a>b'>this page</a> for more of it</p></article>", f"one\ntwo\n{LONG}\nsee this page for more of it"),
    (f"<div role=dialog>{LONG}</div><div style='display: none'>{LONG}</div><div class=story>{LONG}</div>", LONG),
)
ODD = (
    (None, ""),
    ("", ""),
    ("<!-- <p>no</p> --><script>var p = '<p>no</p>'</script><style>p{}</style>", ""),
    (f"<ARTICLE><P>a&nbsp;\n\t b<BR>c &lt;d&gt; &#233; &amp;amp;<p>{LONG}</ARTICLE>", f"a b c <d> é &amp;\n{LONG}"),
    (f"<article><p><b>{LONG}<p>2 < 3 and 4 > 1</b></div></p>rest <i>of</i> it<!-- open", f"{LONG}\n2 < 3 and 4 > 1\nrest of it"),
    (f"<article><p>in<b>to</b> one</p><script>if (a < b) document.write('</p>')</script><p>{LONG}</p><svg><text>no</text></svg></article>", f"into one\n{LONG}"),
)


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(spark)


def texts(spark, tree, pages):
    rows = [(str(i), None, p, "clash", 1) for i, p in enumerate(pages)]
    return [r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA).coalesce(1), tree).collect()]


def test_tree_tells_its_own_table(spark, tree):
    table = html_text.labelled_blocks(spark)
    assert table.filter(html_text.is_text(tree, F.struct(*html_text.FEATURES)) != (F.col("label") == 1)).count() == 0


def test_held_out_pages(spark, tree):
    assert texts(spark, tree, [p for p, _ in HELD_OUT]) == [t for _, t in HELD_OUT]


def test_odd_markup(spark, tree):
    got = texts(spark, tree, [p for p, _ in ODD] + [ODD[3][0]] * 2)
    assert got == [t for _, t in ODD] + [ODD[3][1]] * 2


def test_long_pages_and_many_open_elements(spark, tree):
    page = "<div>" * 3000 + "<article>" + f"<p>{LONG}" * 5000 + "<" * 1000
    assert texts(spark, tree, [page])[0].startswith("\n".join([LONG] * 4999))


def test_empty_table(spark, tree):
    assert html_text.main_text(spark.createDataFrame([], SCHEMA), tree).collect() == []


def test_given_pages(spark, tree):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_text.main_text(pages, tree).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(x for x in parts if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))
