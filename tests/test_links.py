"""The tokenizer and the url functions, against Python's own parsers."""

import time
from html.parser import HTMLParser
from urllib.parse import parse_qs, quote, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressroom.sources import links
from pressroom.sources.html_tokens import anchors, tokens


@pytest.mark.parametrize("page,want", [
    ("<a href=/1>x</a>", [("/1", "", "x")]),
    ("<!-- <a href=/old>o</a> --><a href='/1'> x </a><!--><a href=/2>y</a><!---><a href=/3>z</a>", [("/1", "", "x"), ("/2", "", "y"), ("/3", "", "z")]),
    ("<!-- never closed <a href=/old>o</a>", []),
    ("<script>s = '<a href=/js>'; </scripty></script ><a href=/1>x</a><STYLE><a href=/2></style>", [("/1", "", "x")]),
    ("<script><a href=/js>", []), ("<title><a href=/t>t</a></title><textarea><a href=/u></textarea>", []),
    ("<img alt='<a href=/alt>'><a title=\"a > b\" href=\"/1?a=1&amp;b=&#50;\" class='p q'>&lt;x&gt; &#xac00;</a>", [("/1?a=1&b=2", "p q", "<x> 가")]),
    ("<a\nHREF = /1\nhref=/2>x</A\n>", [("/1", "", "x")]), ("<a title=it's href=/1>x</a>", [("/1", "", "x")]),
    ("<a href>x</a><a name=n>y</a><a href=''>z</a>", [("", "", "x"), ("", "", "z")]),
    ("<a href=/1>b <span>in <span>deep</span> more</span> out <span>second</span></a>", [("/1", "", "in deep more")]),
    ("<a href=/1>one<a href=/2>two</a>", [("/1", "", "one"), ("/2", "", "two")]),
    ("<div><a href=/1>one<b>bold</div>behind<a href=/2>two", [("/1", "", "onebold"), ("/2", "", "two")]),
    ("<b><a href=/1>x</b>y</a>z", [("/1", "", "x")]), ("<a href=/1>x</p>y<br>z</a>", [("/1", "", "xyz")]),
    ("<a href=/1><span>x</a>y<span>", [("/1", "", "x")]), ("1 < 2 <a href=/1>a < b <3</a>", [("/1", "", "a < b <3")]),
    ("<a href=\"/1>never closed", []), ("<a", []), ("<a href=/1", []), ("</a><a/href=/1/>x</a>", [("/1/", "", "x")]),
    ("<abbr href=/no>x</abbr>", []), ("<!DOCTYPE html><?xml <a href=/x>?><a href=/1>x</a>", [("/1", "", "x")]), ("", []),
])
def test_anchors(page, want):
    assert list(anchors(page)) == want


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("start", tag))

    def handle_endtag(self, tag):
        self.found.append(("end", tag))


PIECES = st.sampled_from(["<b>", "</b>", "<p class=x>", "<a href='/1'>", "</a>", "<!-- <b> -->", "text", "<br>", " ", "<span title=\"<b>\">", "</span>", "&amp;"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_tags_as_the_plain_parser_sees_them(pieces):
    parser = Plain()
    parser.feed("".join(pieces))
    parser.close()
    assert [(k, v) for k, v, _ in tokens("".join(pieces)) if k != "text"] == parser.found


def test_linear_in_the_text():
    for bad in ("<a " * 200_000, "<a href=/1>" * 100_000, "<div>" * 200_000 + "</p>" * 200_000, "<a href='" * 100_000, "<!--" * 200_000, "<a " + "x" * 1_000_000,
                "<a x=" + "\"y\" " * 300_000, "<script>" * 100_000):
        began = time.time()
        sum(1 for _ in anchors(bad))
        assert time.time() - began < 5, bad[:20]


def test_rows_of_pages(spark):
    rows = [(1, "<a class='n m' href=/1>one</a><a href=/2>two</a>"), (2, None), (3, ""), (4, "<a class=m href=/1>" + "x" * 3_000_000 + "</a>"), (None, "<a href=/9>n</a>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' AS pos", "'y' AS href").repartition(3)
    got = sorted(((r["page_id"], r["pos"], r["href"], len(r["text"])) for r in links.extract_links(pages).collect()), key=str)
    assert got == sorted([(1, 0, "/1", 3), (1, 1, "/2", 3), (4, 0, "/1", 3_000_000), (None, 0, "/9", 1)], key=str)
    assert [(r["page_id"], r["href"]) for r in links.extract_links(pages, css_class="m n").collect()] == [(1, "/1")]
    assert links.extract_links(pages.limit(0)).count() == 0


URLS = ["http://h/p?officeId=023", "/main?officeId=02 3", "?a=1|2&officeId=023", "?officeId=&officeId=9", "/p?officeId=1#officeId=2", "/p#x?officeId=2", "?x=1&officeId", "",
        "?officeId=a+b%20c%2Bd", "?officeId=%zz%4", "?office%49d=7", "?officeId=1=2", "?officeId=%EA%B0%80&officeId=2", "http://[::1]/?officeId=5", "?a?b&officeId=6", "mailto:x?officeId=8",
        "?officeId=1\n2", "?&&officeId=3&&", "?officeId=;x&y=1"]


def test_query_values_as_parse_qs_gives_them(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(99, None)], "i int, url string")
    got = {r["i"]: r["v"] for r in df.select("i", links.query_value(F.col("url"), "officeId").alias("v")).collect()}
    want = {i: (parse_qs(urlparse(u.replace("\n", "\x01")).query).get("officeId") or [None])[0] for i, u in enumerate(URLS)}
    assert got == {i: v and v.replace("\x01", "\n") for i, v in want.items()} | {99: None}


def test_quote(spark):
    texts = ["윤석열 탄핵", "a b+c/d", "*~-_.!'()", "%41", "", "é\U0001f600\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", links.quote(F.col("t")).alias("q"), links.quote(F.col("t"), safe="").alias("n"), links.unquote(links.quote(F.col("t"))).alias("back")).collect()
    assert [(r["t"], r["q"], r["n"], r["back"]) for r in rows] == [(t, quote(t), quote(t, safe=""), t) for t in texts]
