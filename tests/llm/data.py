"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that the operators use for columns of their own.
CLASH = ["doc", "key", "block", "size", "weight", "rank", "label", "n", "task", "bucket", "target", "kept", "own_key", "seen_key", "Seen_Before", "kept_id", "weighed_text", "copied_id",
         "copies", "copy", "n_lines", "n_removed", "word", "node", "score", "mark", "spans", "side"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["an", "tor", "é", "li", "Mo", "ß", "qu", "ne"], k=rng.randint(1, 3))) for _ in range(n)]


def rows() -> list[tuple]:
    rng = random.Random(7)
    passage = words(rng, 70)
    template = words(rng, 120)
    out = []
    for i in range(60):
        body = words(rng, rng.randint(0, 150))
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        if i % 7 == 0:
            body = list(template)
            body[rng.randrange(120)] = "changed"
        text = " ".join(body)
        if i % 3 == 0:
            text = text.replace(" an", "\nan").replace(" ", "  ", 1)
        out.append((i * 3, text, ["en", "fr", None][i % 3], ["a", "b", "", None, "é"][i % 5], len(text)))
    lines = "first line here\nsecond line here\n\nthird line here\nfourth line"
    out += [
        (500, None, "en", "a", None), (501, "", None, None, 0), (502, " \n\t ", "en", "a", 4), (503, "one two", "en", "a", 7),
        (504, "one two", "en", "a", 7), (505, out[8][1], "en", "a", 1), (506, lines, "en", "b", 1), (507, "x\n" + lines + "\n" + lines, "en", "b", 1),
        (None, "no id " + lines, "en", "b", 1), (None, None, None, None, None), (508, "emoji 😀 日本語 <|endoftext|> 's", "ja", "a", 1),
        (509, " ".join(words(rng, 6000)), "en", "a", 1), (510, "tok " * 400, "en", "a", 1), (511, "%%% *** && " * 40, "en", "a", 1),
    ]
    rng.shuffle(out)
    return out


def documents(spark, extra: bool = False, empty: bool = False):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA).repartition(3)
    if extra:
        for name in CLASH:
            df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


def order(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id
