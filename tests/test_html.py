"""Unit tables for the HTML pass and the native paragraph chain (literal input → output)."""

import pytest
from pyspark.sql import functions as F

from trawl.operators.html import parse_page
from trawl.operators.pages import analyze_pages, paragraph_rows


def blocks(html):
    return parse_page(html, "http://h/a/b?q=1")[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        # nested containers emit overlapping text
        ("<article><h1>T</h1><p>x</p></article>", ["Tx", "T", "x"]),
        # no implied closing: the second p nests in the first
        ("<p>x<p>y</p>z</p>", ["xyz", "y"]),
        # pieces stripped one by one, joined without separator
        ("<p><b>a</b> c</p>", ["ac"]),
        # comments split text runs
        ("<p>a <!-- c --> b</p>", ["ab"]),
        # a script holding </p> is code, then removed
        ('<p>k</p><script>var t="</p>";</script>', ["k"]),
        # headings inside header are dropped with it
        ("<header><h1>gone</h1></header><h2>kept</h2>", ["kept"]),
        # entity without ';' before a tag is decoded
        ("<h1>and&amp</h1>", ["and&"]),
        # unmatched end tag ignored; end tag pops to nearest match
        ("<p>a</div>b</p>c", ["ab"]),
        ("<div><p>a</div>b", ["a"]),
        # void elements hold nothing
        ("<p>a<br>b</p>", ["ab"]),
        # empty elements give empty blocks (dropped later)
        ("<p></p><p> </p>", ["", ""]),
        # numeric references, low ones read as windows-1252
        ("<p>&#233;&#x41;&#150;</p>", ["éA–"]),
    ],
)
def test_blocks(html, expected):
    assert blocks(html) == expected


def test_links_and_resolution():
    base = "http://h/a/b?q=1"
    html = ('<a href="">e</a><a href="#f">f</a><a href="javascript:void(0)">j</a>'
            '<a href="javascript/x.html">r</a><a href="mailto:a@b">m</a><a href="http://[">bad</a>'
            '<a>no href</a><a href>bare</a>')
    _, hrefs, links, _, _ = parse_page(html, base)
    assert hrefs == ["", "#f", "javascript:void(0)", "javascript/x.html", "mailto:a@b", "http://[", ""]
    assert links == [base, base + "#f", "javascript:void(0)", "http://h/a/javascript/x.html", "mailto:a@b", base]
    b2 = "http://h/a/b"
    _, _, links2, _, _ = parse_page('<a href="../../c"><a href="?z=1"><a href="//o/x"><a href="HTTP://X/y">', b2)
    assert links2 == ["http://h/c", "http://h/a/b?z=1", "http://o/x", "http://X/y"]


def test_result_selector():
    html = ('<li class="b_algo x"><h2><a href="r1">1</a></h2><a href="no">n</a></li>'
            '<li class="b_ad"><h2><a href="ad">a</a></h2></li>'
            '<li class="b_algo"><div><h2><span><a href="r2">2</a><a>x</a><a href="">y</a></span></h2></div></li>')
    assert parse_page(html, None, want_results=True)[3] == ["r1", "r2"]


def test_native_chain(spark):
    # order: drop empty → dedup → > 3 words → collapse (dedup before collapse keeps both)
    html = ("<p>one two three</p><p>one two three four</p><p>one two three four</p>"
            "<p>one  two three four</p><p>a\xa0b\x1cc d e</p><p>a b c</p><p></p>")
    df = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    rows = paragraph_rows(analyze_pages(df, keys=["page_id"]), keys=["page_id"]).orderBy("para_idx").collect()
    assert [r.text for r in rows] == ["one two three four", "one two three four", "a b c d e"]
    assert [r.para_idx for r in rows] == [0, 1, 2]


def test_page_without_html(spark):
    df = spark.createDataFrame([(1, "http://h/x", None)], "page_id long, url string, html string")
    a = analyze_pages(df, keys=["page_id"]).collect()[0]
    assert a.paragraphs == [] and a.links == []
    assert F is not None


@pytest.mark.parametrize("html", ["<p>a</p><![foo[bar]]>", "<p>x<![ endif ]--></p>"])
def test_rejected_markup_gives_empties_and_the_rest_goes_on(spark, html):
    rows = [("http://h/bad", html), ("http://h/ok", "<p>one two three four</p>"), ("http://h/none", None)]
    got = {r.url: r for r in analyze_pages(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["http://h/ok"].paragraphs == ["one two three four"] and not got["http://h/ok"].parse_error
    assert not got["http://h/none"].parse_error
    rejected = got["http://h/bad"]
    assert rejected.parse_error == (parse_page(html, None)[4]) and (not rejected.parse_error or rejected.paragraphs == [])
    assert parse_page("<p>a</p><![foo[bar]]>", None)[4]


def test_text_runs_are_kept_once_however_deep_the_blocks():
    from trawl.operators.html import PageParser

    p = PageParser()
    p.feed("".join(f"<p>t{i}" for i in range(20_000)))
    p.close()
    p._flush()
    assert len(p.runs) == 20_000 and len(p.spans) == 20_000  # a run and a span each, no copies
    blocks = parse_page("<div><p>a<p>b</p>c</div><p><p>x", None)[0]
    assert [b for b in blocks if b][-2:] == ["x", "x"] and "abc" in "".join(blocks)
