from __future__ import annotations

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from nearprint.functions import html
from nearprint.sources import sites
from tests.conftest import SF_DIR


def pages(spark, *items):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(items)], "page_id long, url string, html string")


ARTICLE_A = """<html><head><title>JO BLOGGS: On: a fine day &amp; night | Daily Mail Online</title></head><body>
<p class="mol-para-with-font">outside</p>
<div itemprop="articleBody"><div class="ad">skip</div>
<div><p class="mol-para-with-font">First <b>bold</b> part.</p></div>
<p class="mol-para-with-font other">Second&nbsp;part.</p><p class="caption">no</p></div>
<p class="mol-para-with-font">after</p></body></html>"""

ARTICLE_B = """<article><h1 class="headline">A headline</h1></article>
<div class="article-padding article-content"><p>One <a href="x">link</a>.</p>
<div class="inews__shortcode-readmore__text"><p>Read more: other</p></div>
<div class="box"><p>Two.<p>Three.</p></div></div><p>outside</p>"""


def test_articles(spark, rows):
    found = rows(sites.read_articles(pages(spark, ("http://a", ARTICLE_A), ("http://x", "<p>nothing</p>")), sites.DAILY_MAIL))
    assert [r[1:] for r in found] == [("http://a", "a fine day & night", "First bold part. Second\xa0part.")]
    found = rows(sites.read_articles(pages(spark, ("http://b", ARTICLE_B)), sites.I_NEWS))
    assert [r[1:] for r in found] == [("http://b", "A headline", "One link. Two. Three.")]


LISTING_A = """<div class="debate item"><a class="js-tl" href="/news/columnist-1/A.html"> PETER McKAY </a></div>
<div class="debate item"><a class="js-tl" href="https://blogs.example/x">Off Site</a>
<a class="js-tl" href="/news/columnist-2/B.html">jean-paul o'neil</a><a href="/no">No Author</a></div>
<a class="js-tl" href="/outside">Out Side</a>"""
LISTING_B = """<div class="inews__post-section inews__post-section__cat-columnists">
<span class="inews__post__category"><a title="Ann Other" href="https://inews.co.uk/author/a">x</a><a title="No" href="https://no">y</a></span>
<span class="inews__post__category"><a title="Ann Other" href="https://inews.co.uk/author/b">x</a></span></div>
<span class="inews__post__category"><a title="Out" href="https://inews.co.uk/author/c">x</a></span>"""


def test_authors(spark, rows):
    assert rows(sites.read_authors(pages(spark, ("http://l", LISTING_A)), sites.DAILY_MAIL)) == [
        ("Jean-Paul O'Neil", "https://www.dailymail.co.uk/news/columnist-2/B.html"),
        ("Peter Mckay", "https://www.dailymail.co.uk/news/columnist-1/A.html"),
    ]
    assert rows(sites.read_authors(pages(spark, ("http://l", LISTING_B)), sites.I_NEWS)) == [
        ("Ann Other", "https://inews.co.uk/author/b"),
    ]


HOME_A = """<a href="/before.html">x</a><div class="columnist-archive-page link-box linkro-darkred">
<a href="/debate/article-1/x.html">x</a><a href="/debate/article-1/x.html">again</a><a href="https://www.dailymail.co.uk/y.html">y</a>
<a href="/list?pageOffset=2">more</a></div><a href="/after.html">x</a>"""
HOME_B = """<div class="inews__main row"><h2><a href="https://inews.co.uk/opinion/a">a</a><a href="https://inews.co.uk/no">n</a></h2>
<h2><a href="https://elsewhere.example/b">b</a></h2><a href="https://inews.co.uk/plain">p</a></div>"""


def test_links(spark, rows):
    columnists = spark.createDataFrame([("Zed", "http://h"), ("Ann", "http://h2"), ("Old", "http://gone")], "columnist string, homepage string")
    found = rows(sites.read_links(pages(spark, ("http://h", HOME_A), ("http://h2", HOME_A)), sites.DAILY_MAIL, columnists))
    assert sorted((r[0], r[2]) for r in found) == [
        ("Ann", "https://www.dailymail.co.uk/debate/article-1/x.html"), ("Ann", "https://www.dailymail.co.uk/y.html"),
    ]
    found = rows(sites.read_links(pages(spark, ("http://h", HOME_B)), sites.I_NEWS, columnists))
    assert [(r[0], r[2]) for r in found] == [("Zed", "https://inews.co.uk/opinion/a")]


def test_visible_text_golden(spark):
    body = "<p>About every three months. </p> <p>Such engagement will not be easy. </p> <p><ahref=\"mailto:a@b\">g.y@t.com</a></p> "
    text = pages(spark, ("u", body)).select(html.visible_text("html")).first()[0]
    assert text == "About every three months. Such engagement will not be easy. g.y@t.com"


def test_hidden_parts_and_entities(spark):
    markup = "<style>p{}</style><script>var t='</p>';</script><!-- <p>c</p> --><p>a &amp;lt; b&nbsp;&copy;</p>"
    row = pages(spark, ("u", markup)).select(html.visible_text("html").alias("t")).first()
    assert row.t.replace("\xa0", " ") == "a &lt; b ©"


def test_paragraphs_read_unclosed_ones_once(spark):
    markup = "<article><p><b>one<br><p>two</p>between<p class='x'>three</p></article>"
    found = pages(spark, ("u", markup)).select(html.paragraphs(html.article_markup("html"))).first()[0]
    assert found == ["one", "two", "three"]


def test_both_readers_agree_on_the_given_pages(spark):
    """Column expressions and the nesting-aware reader give the same paragraphs."""
    given = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    site = sites.Site(
        publication="x", base_url="", title=(sites.element("article"), sites.element("h1")), body=sites.element("article"),
        paragraph=sites.element("p"), links=sites.element("nav"), link=(sites.element("a"),), authors=(),
    )
    parsed = {r.url: (r.title, r.content) for r in sites.read_articles(given, site).collect()}
    found = html.paragraphs(html.article_markup("html"))
    columns = given.select("url", html.headline("html").alias("title"), F.array_join(found, " ").alias("content"))
    assert {r.url: (r.title, r.content) for r in columns.collect()} == parsed
    assert len(parsed) == given.count()


class Reader(HTMLParser):
    """Links and text as the standard parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.texts, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "a" and dict(attrs).get("href"):
            self.hrefs.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)


HOSTILE = [
    '<a href="/it\'s-here">x</a>',
    "<a href='/say-\"hi\"'>x</a>",
    '<a data-href="/bad" href="/good">x</a>',
    '<a title="x href=/bad" class=c href="/good">x</a>',
    "<a href=/plain>x</a><a class=big href=/plain?a=1&amp;b=2 >y</a>",
    '<!-- <a href="/hidden">x</a> --><a href="/seen">x</a>',
    '<!-- <script> --><a href="/seen">x</a><script>let a = "<a href=/no>n</a>"</script>',
    '<a\n  HREF = "/spread"\n>x</a><a name="none">y</a><a href="">z</a>',
    '<a title="a > b" href="/after">text</a>',
    "<p>caf&eacute; &pound;5 don&#8217;t &#x201C;quote&#x201D; &notin; &copy 2020 &nosuch; a &amp;lt; b &#128;</p>",
    '<p title="a > b">text</p> 1 < 2 <b>bold</b>',
    "<style>p > a { color: red }</style><p>after</p>",
    "",
]


@pytest.mark.parametrize("markup", HOSTILE)
def test_column_rules_against_the_parser(spark, markup):
    reader = Reader()
    reader.feed(markup)
    reader.close()
    given = pages(spark, ("https://s.example/a", markup))
    links, text = given.select(html.anchors("html"), html.visible_text("html")).first()
    assert [link.href for link in links] == reader.hrefs
    assert text.split() == " ".join(reader.texts).split()


def test_null_markup(spark, rows):
    given = pages(spark, ("u", None))
    assert rows(given.select(html.visible_text("html"), html.title("html"), html.anchors("html"))) == [(None, None, None)]
    assert rows(sites.read_authors(given, sites.DAILY_MAIL)) == []


def test_article_ends_where_it_ends(spark):
    markup = "<article><p>one</p></article><aside><p>aside</p></article></aside><article><p>two</p></article>"
    assert pages(spark, ("u", markup)).select(html.paragraphs(html.article_markup("html"))).first()[0] == ["one"]


def test_many_attributes_and_no_end(spark):
    long_tag = "<p " + "a=1 " * 50_000 + ">text</p>"
    open_tag = "text<p " + "a='1' " * 50_000
    found = [r[0] for r in pages(spark, ("u", long_tag), ("v", open_tag)).select(html.visible_text("html")).collect()]
    assert found[0] == "text" and found[1].startswith("text")


def test_unreadable_pages_are_rows(spark, rows):
    given = pages(spark, ("http://a", ARTICLE_A), ("http://n", None), ("http://t", "<p>nothing</p>"), ("http://b", "<title>t</title>"))
    read = sites.read_pages(given, sites.DAILY_MAIL)
    assert rows(read.select("url", "problem")) == [
        ("http://a", None), ("http://b", "no body"), ("http://n", "no markup"), ("http://t", "no title"),
    ]


def test_links_inside_others_and_without_end(spark):
    cases = {
        '<a href="/one">1<a href="/two">2</a>3</a>4': [("/one", "123"), ("/two", "2")],
        '<a href="/a">x</a> <a href="/b">y': [("/a", "x"), ("/b", "y")],
        '<a href="/a">x<a href="/b">y</a>z': [("/a", "xyz"), ("/b", "y")],
        '<a href="/a"><b>x</b></a></a><a>no</a><a href="/c"></a>': [("/a", "x"), ("/c", "")],
        "no link": [],
    }
    pages = spark.createDataFrame([(m,) for m in cases], "m string")
    for row in pages.select("m", html.anchors("m").alias("found")).collect():
        assert [tuple(link) for link in row.found] == cases[row.m], row.m
