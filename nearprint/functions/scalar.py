"""Column-to-column functions.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions, in the common subset of Java and RE2 syntax.
_API_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
_EDGE_SPACE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"
_LETTER_RUNS = r"\p{L}+|\P{L}+"
_URL_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
_URL_ROOT = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def article_id(key: Column | str) -> Column:
    """Surrogate id: md5 of the UTF-8 bytes, as lowercase hex."""
    return F.md5(_col(key).cast("string"))


def parse_api_timestamp(text: Column | str) -> Column:
    """``2020-10-04T10:35:19Z`` to a timestamp without zone; anything else is null.

    The session time zone plays no part, so clock changes cannot shift a value.
    """
    text = _col(text)
    return F.when(text.rlike(_API_TIMESTAMP), F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def format_api_timestamp(ts: Column | str) -> Column:
    """The inverse of :func:`parse_api_timestamp`, null-safe, second precision."""
    seconds = F.substring(_col(ts).cast("timestamp_ntz").cast("string"), 1, 19)
    return F.concat(F.translate(seconds, " ", "T"), F.lit("Z"))


def strip(text: Column | str) -> Column:
    """Remove white space at both ends, the no-break space included."""
    return F.regexp_replace(_col(text), _EDGE_SPACE, "")


def squeeze_spaces(text: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def strip_key_padding(key: Column | str) -> Column:
    """Remove the blanks a fixed-width key column is padded with."""
    return F.rtrim(_col(key))


def after_last(text: Column | str, separator: str) -> Column:
    """What follows the last occurrence of a literal separator, or the whole text."""
    return F.substring_index(_col(text), separator, -1)


def without(text: Column | str, literal: str) -> Column:
    """Remove every occurrence of a literal."""
    return F.replace(_col(text), F.lit(literal), F.lit(""))


def page_title(text: Column | str, author_separator: str, site_suffix: str) -> Column:
    """Reduce ``Author: Title | Site`` to the title."""
    return strip(without(after_last(text, author_separator), site_suffix))


def title_case(text: Column | str) -> Column:
    """Capitalise every run of letters (``o'neil`` gives ``O'Neil``) and strip."""
    runs = F.regexp_extract_all(_col(text), F.lit(_LETTER_RUNS), F.lit(0))
    return strip(F.array_join(F.transform(runs, F.initcap), ""))


def join_words(words: Column | str) -> Column:
    """Concatenate the parts with one space between them."""
    return F.array_join(_col(words), " ")


def first_chars(text: Column | str, n: int) -> Column:
    return F.substring(_col(text), 1, n)


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(_col(text), r"\s+"), 1, n), " ")


def parse_vector(text: Column | str) -> Column:
    """``{1.0, 0.0}`` or ``[1.0, 0.0]`` to an array of doubles."""
    body = F.regexp_replace(_col(text), r"[{}\[\]\s]", "")
    return F.when(body == "", F.array().cast("array<double>")).otherwise(
        F.split(body, ",").cast("array<double>")
    )


def format_vector(vector: Column | str) -> Column:
    """An array of doubles to ``{1.0,0.0}``; the text parses back to the same values."""
    return F.concat(F.lit("{"), F.array_join(_col(vector).cast("array<string>"), ","), F.lit("}"))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Resolve a link against the page it was found on.

    Handles the forms a link can take: absolute, scheme-relative, rooted, query only,
    fragment only, empty, and relative to the directory of the page, with ``.`` and
    ``..`` segments removed.
    """
    base, href = _col(base), _col(href)
    root = F.regexp_extract(base, _URL_ROOT, 1)
    page = F.regexp_replace(base, r"#.*$", "")
    document = F.regexp_replace(page, r"\?.*$", "")
    directory = F.when(document == root, F.concat(root, F.lit("/"))).otherwise(
        F.regexp_replace(document, r"[^/]*$", "")
    )
    rooted = F.concat(root, href)
    relative = F.concat(directory, href)
    return (
        F.when(href.rlike(_URL_SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/]*)//", 1), href))
        .when(href.startswith("/"), _resolve_dots(root, rooted))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(page, href))
        .when(href.startswith("?"), F.concat(document, href))
        .otherwise(_resolve_dots(root, relative))
    )


def _resolve_dots(root: Column, url: Column) -> Column:
    path = F.regexp_extract(F.substr(url, F.length(root) + 1), r"^([^?#]*)", 1)
    tail = F.substr(url, F.length(root) + F.length(path) + 1)
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda done, part: (
            F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .when(part == ".", done)
            .otherwise(F.concat(done, F.array(part)))
        ),
    )
    # A path that ends in a dot segment names a directory.
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(
        path.contains("/.") | path.startswith("."), F.concat(root, F.array_join(kept, "/"), tail)
    ).otherwise(url)
