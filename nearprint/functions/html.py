"""Text, titles, paragraphs, links and authors from HTML, as column expressions.

These rules read markup without building a tree, so they stay on the JVM; only texts that
hold a character reference go through Python, in Arrow batches.  Elements that must be
matched by nesting (a container inside others of the same name) are read by
:mod:`nearprint.sources.sites` instead.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearprint.functions.scalar import _col, absolute_url, strip, title_case

# The rest of a tag.  A ">" in a quoted value does not end it, and quotes count only after
# "=".  Possessive, so that a page without a closing ">" costs no backtracking.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_REST = rf"(?:[^=>]++|=\s*+{_VALUE}?+)*+>"

# Whichever starts first hides the others inside it.
HIDDEN = rf"(?is)<!--.*?-->|<script(?=[\s/>]){_REST}.*?</script\s*+>|<style(?=[\s/>]){_REST}.*?</style\s*+>"
TAG = rf"<[/!?a-zA-Z]{_REST}"
TITLE = rf"(?is)<title(?=[\s/>]){_REST}(.*?)</title\s*+>"
HEADLINE = rf"(?is)<h1(?=[\s/>]){_REST}(.*?)</h1\s*+>"
ARTICLE = rf"(?is)<article(?=[\s/>]){_REST}(.*?)</article\s*+>"
PARAGRAPH_START = rf"(?i)<p(?=[\s/>]){_REST}"
PARAGRAPH_END = r"(?i)</p\s*+>"
ANCHOR_START = rf"(?is)<a(?=\s){_REST}"
ANCHOR_END = r"(?i)</a\s*+>"
# Attributes of other names are passed over whole, with what their values hold.
HREF = rf"(?is)^<a(?:[\s/]++(?!href[\s=])[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+)*+[\s/]++href\s*+=\s*+({_VALUE})"
QUOTED = r"""(?s)^(["'])(.*)\1$"""


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescaped(texts: pa.Array) -> pa.Array:
    rows = texts.to_pylist()
    return pa.array([row and [text and unescape(text) for text in row] for row in rows], pa.list_(pa.string()))


def decode_all(texts: Column) -> Column:
    """An array of texts with every character reference decoded, as a parser would."""
    # Only arrays that hold a reference are sent to Python.
    some = F.exists(texts, lambda text: text.contains("&"))
    return F.coalesce(_unescaped(F.when(some, texts)), texts)


def decode_entities(text: Column | str) -> Column:
    return F.get(decode_all(F.array(_col(text))), F.lit(0))


def visible_markup(html: Column | str) -> Column:
    """The markup without scripts, style sheets and comments."""
    return F.regexp_replace(_col(html), HIDDEN, "")


def _untagged(markup: Column) -> Column:
    return F.regexp_replace(markup, TAG, "")


def without_tags(markup: Column | str) -> Column:
    """The text between the tags, unchanged otherwise."""
    return decode_entities(_untagged(_col(markup)))


def visible_text(html: Column | str) -> Column:
    """Every text node stripped, empty ones dropped, joined by one space."""
    nodes = F.transform(decode_all(F.split(visible_markup(html), TAG)), strip)
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def title(html: Column | str) -> Column:
    return without_tags(F.regexp_extract(visible_markup(html), TITLE, 1))


def headline(html: Column | str) -> Column:
    return without_tags(F.regexp_extract(visible_markup(html), HEADLINE, 1))


def article_markup(html: Column | str) -> Column:
    """What the first article holds, up to the first end tag."""
    return F.regexp_extract(visible_markup(html), ARTICLE, 1)


def paragraphs(markup: Column | str) -> Column:
    """Texts of the paragraphs.

    A paragraph ends at its end tag or where the next one starts, so text after an
    unclosed ``<p>`` is read once.
    """
    parts = F.split(_col(markup), PARAGRAPH_START)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    return decode_all(F.transform(bodies, lambda part: _untagged(F.get(F.split(part, PARAGRAPH_END), 0))))


def _inside(bodies: Column, at: Column) -> Column:
    """The markup up to the end tag that belongs to the start tag before body ``at``.

    Each further body follows a start tag, so it opens one link more.  Without an end tag the
    link reaches to the end of the markup.
    """

    def step(state: Column, body: Column) -> Column:
        pieces = F.split(body, ANCHOR_END)
        depth, ends = state["depth"] + 1, F.size(pieces) - 1
        closed = ends >= depth
        read = F.concat(state["text"], F.array_join(F.when(closed, F.slice(pieces, F.lit(1), depth)).otherwise(pieces), ""))
        after = F.struct(F.when(closed, F.lit(-1)).otherwise(depth - ends).alias("depth"), read.alias("text"))
        return F.when(state["depth"] < 0, state).otherwise(after)

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    rest = F.slice(bodies, at + 1, F.size(bodies))
    # Nearly all links end before the next one starts; only others are read on.
    plain = F.split(F.get(bodies, at), ANCHOR_END)
    return F.when(F.size(plain) > 1, F.get(plain, 0)).otherwise(F.aggregate(rest, start, step, lambda state: state["text"]))


def anchors(markup: Column | str) -> Column:
    """``[(href, text)]`` of the links in document order; links in comments do not count.

    A link inside another one counts too, and its text belongs to both.  One that is not
    closed reaches to the end of the markup.
    """
    visible = visible_markup(markup)
    starts = F.regexp_extract_all(visible, F.lit(ANCHOR_START), F.lit(0))
    parts = F.split(visible, ANCHOR_START)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    hrefs = F.transform(starts, lambda a: F.regexp_replace(F.regexp_extract(a, HREF, 1), QUOTED, "$2"))
    texts = F.transform(starts, lambda _, at: _untagged(_inside(bodies, at)))
    pairs = F.zip_with(
        decode_all(hrefs),
        decode_all(texts),
        lambda href, text: F.struct(href.alias("href"), text.alias("text")),
    )
    return F.filter(pairs, lambda a: a["href"] != "")


def article_links(markup: Column | str, base: Column | str, unwanted: str = "pageOffset", prefix: str = "") -> Column:
    """Distinct absolute links, leaving out paging links and links to other sites."""
    base = _col(base)
    kept = F.filter(anchors(markup), lambda a: ~a["href"].contains(unwanted))
    urls = F.transform(kept, lambda a: absolute_url(base, a["href"]))
    return F.array_distinct(F.filter(urls, lambda u: u.startswith(prefix)))


def author_entries(markup: Column | str, base: Column | str, prefix: Column | str) -> Column:
    """``[(columnist, homepage)]`` in document order, links to other sites left out."""
    base, prefix = _col(base), _col(prefix)
    entries = F.transform(
        anchors(markup),
        lambda a: F.struct(
            title_case(a["text"]).alias("columnist"), absolute_url(base, a["href"]).alias("homepage")
        ),
    )
    return F.filter(entries, lambda e: e["homepage"].startswith(prefix))
