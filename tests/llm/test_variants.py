"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from nearprint.llm import variants
from tests.llm.data import documents, rows

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def given() -> list[tuple]:
    rng = random.Random(11)
    stems = ["".join(rng.choices("abcdeéßmno", k=rng.randint(6, 9))) for _ in range(12)] + ["x" * 60, "abcdef×÷"]
    out = [r[:2] for r in rows()]
    for k in range(150):
        words = []
        for stem in rng.choices(stems, weights=range(1, len(stems) + 1), k=40):
            at, what = rng.randrange(len(stem)), rng.choice(["", "", "", "a", "é", "bc", "keep", "keep", "keep"])
            words.append(stem if what == "keep" else stem[:at] + what + stem[at + 1 :])
        out.append((10_000 + k, rng.choice([" ", ", ", "Δ", "7"]).join(words).title() if k % 9 == 0 else " ".join(words)))
    out += [(30_000 + k, " ".join(["kkkkkk"] * 130 + ["kkkkkz"] * 26 + ["kkkkzz"] * 5)) for k in range(3)]
    return out + [out[-1], (None, out[-2][1]), (20_000, "a" * 3_000 + " " + "b" * 40)]


GIVEN = given()


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(pairs, every=199, least=6, often=5, ratio=5) -> set:
    many = Counter()
    for doc_id, text in pairs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            many[run] += len(run) >= least
    many = {w: n for w, n in many.items() if n >= often}
    near = {w: [v for v in many if one_apart(w, v)] for w in many}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-many[v], v), default=None)
        if best is not None and many[best] >= ratio * many[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), many.get(form.get(w))) for w, n in many.items()}


def table(spark, extra: bool = False):
    docs = spark.createDataFrame(GIVEN, "doc_id bigint, text string").repartition(3)
    for name in ("word", "n", "node", "vector", "id", "stored", "move", "up") if extra else ():
        docs = docs.selectExpr("*", f"'own' AS `{name}`")
    return docs


def found(df) -> set:
    out = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("every", [199, 3, None])
def test_groups(spark, every):
    expected = brute(GIVEN, every)
    assert any(form for _, form, *_ in expected)
    assert every or any(root not in (word, form) for word, form, root, *_ in expected)
    assert found(variants.group(table(spark, extra=True), every=every)) == expected


@pytest.mark.parametrize("held", [1, 8])
def test_large_nodes_are_opened(spark, monkeypatch, held):
    monkeypatch.setattr(variants, "NODE_WORDS", held)
    monkeypatch.setattr(variants, "BATCH", 16)
    assert found(variants.group(table(spark))) == brute(GIVEN)


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE_CHARS", 5)
    monkeypatch.setattr(variants, "TALLY", 10)
    assert found(variants.group(table(spark))) == brute(GIVEN)


def test_empty_tables(spark):
    assert variants.group(documents(spark, empty=True)).collect() == []
    assert variants.group(spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id bigint, text string")).collect() == []


def test_verification_equals_comparing_letters():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(6, 7))) for _ in range(200)} | {"q" * 60, "q" * 61, "q" * 59 + "r"})
    raw = [w.encode("latin-1") for w in words]
    spelled = variants.Spelled(raw)
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words))]
    i, j = (variants.np.array(side) for side in zip(*pairs, strict=True))
    expected = [one_apart(words[a], words[b]) for a, b in pairs]
    assert variants.verify(spelled, i, spelled, j).tolist() == expected
    assert [variants.one_apart(raw[a], raw[b]) for a, b in pairs] == expected


def test_roots_follow_long_paths(spark):
    path = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)], "word string, form string")
    led = {r.word: r.root for r in variants.roots(path, 5 * 5**9).collect()}
    assert led == {f"w{k}": "w9" for k in range(9)}
