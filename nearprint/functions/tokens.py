"""Token rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character is a letter, a digit or an underscore.  Encoding keeps
# runs of two or more; normalisation keeps every run.
ENCODER_TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
WORD_WITH_APOSTROPHE = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encoder_tokens(text: Column | str) -> Column:
    """Lowercase runs of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(ENCODER_TOKEN), F.lit(0))


def words(text: Column | str) -> Column:
    """Runs of word characters, case kept: hyphens and apostrophes separate."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_TOKEN), F.lit(0))


def expand_contractions(text: Column | str, contractions: dict[str, str]) -> Column:
    """Replace whole words by their expansion, looked up in lower case."""
    if not contractions:
        return _col(text)
    pairs = [F.lit(part) for item in contractions.items() for part in item]
    table = F.create_map(*pairs)
    found = F.regexp_extract_all(_col(text), F.lit(WORD_WITH_APOSTROPHE), F.lit(0))
    return F.array_join(
        F.transform(
            found,
            lambda w: F.when(w.rlike("['’]"), F.coalesce(F.try_element_at(table, F.lower(w)), w)).otherwise(w),
        ),
        " ",
    )


def count_words(tokens: Column | str) -> Column:
    """``[b, a, a]`` to ``[(a, 2), (b, 1)]`` within the row, without a shuffle.

    In the sorted array a word starts where it differs from its left neighbour; its
    count is the distance to the next start.
    """

    def starts(ordered: Column) -> Column:
        here = F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i))
        return F.filter(here, lambda i: i.isNotNull())

    def counted(ordered: Column, first: Column) -> Column:
        return F.transform(
            first,
            lambda p, j: F.struct(
                F.get(ordered, p).alias("word"),
                (F.coalesce(F.get(first, j + 1), F.size(ordered)) - p).alias("tf"),
            ),
        )

    return _let(F.sort_array(_col(tokens)), lambda o: _let(starts(o), lambda first: counted(o, first)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value inside an expression so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
