"""Personal data against the four patterns, and what the parsers add to them."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from nearprint.llm import pii
from tests.llm.data import documents, rows

ROWS = rows()
ANCHORS = pii.automaton()
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
PERSONAL = [
    "write to ann.lee+x@mail.example.com, or call +1 (017) 555-7713.", "10.0.0.1.2.3.4.5 and 300.1.1.1", "card 4111 1111 1111 1111 ok",
    "4111-1111-1111-1112 no", "é ünï josé@exämple.org 😀 a@b.c", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "a@b@c.d..e", "+12 3", "1" * 5000,
    "@" * 3000 + "+" * 3000, ("x" * 200_000) + "@mail.org", "IBAN: DE89 3704 0044 0532 0130 00.", "1.2.3.4 " * 2000,
]


def valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def by_patterns(text: str) -> dict:
    return {kind: [m.span() for m in pattern.finditer(text) if valid(kind, m.group())] for kind, pattern in PATTERNS.items()}


def table(spark, extra: bool = False):
    base = documents(spark, extra)
    more = [(1000 + k, text) for k, text in enumerate(PERSONAL)] + [(1000, PERSONAL[0]), (None, PERSONAL[1])]
    return base.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True), [*[r[:2] for r in ROWS], *more]


def test_fixed_kinds_equal_their_patterns():
    rng = random.Random(3)
    for alphabet in ("a@.-1", "12.3", "1234 -", "+1 ().9-", "a@b.c+1 -(é", "0123456789", "@@a..b-", "12345678901234567890 -+."):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            found = pii.Reader(text).read(ANCHORS)
            assert {kind: found[kind] for kind in PATTERNS} == by_patterns(text), text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "account", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("API_KEY: abcd1234efgh5678ij.", "account", "abcd1234efgh5678ij"), ("IBAN DE89 3704 0044 0532 0130 00 and more", "account", "DE89 3704 0044 0532 0130 00"),
    ("SSN 123-45-6789", "account", "123-45-6789"), ("password: hunter22!", "account", "hunter22"), ("konto nr: 12345678", "account", "12345678"),
    ("josé.núñez@exämple.com", "mailbox", "josé.núñez@exämple.com"), ("ann (at) mail (dot) org.", "mailbox", "ann (at) mail (dot) org"),
    ("see ssh://ann:pw@host.org:22/x", "address", "ssh://ann:pw@host.org:22"), ("http://10.0.0.1:80/a", "address", "http://10.0.0.1:80"),
    ("tel:+1-555-010-9999", "address", "tel:+1-555-010-9999"), ("mailto:ann@b.org?x", "address", "mailto:ann@b.org"),
])
def test_added_kinds(text, kind, found):
    spans = [(s, e) for s, k, e in pii.spans_in(text, ANCHORS) if pii.KINDS[k] == kind]
    assert [text[s:e] for s, e in spans] == [found]


@pytest.mark.parametrize("text", [
    "the secret is out there, my account is closed", "https://example.com/path?q=1", "Version 2.0. of 1990-2024", "token = x", "IBAN DE00 3704 0044 0532 0130 00",
    "tokenised = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "password protected", "a:b @ c", "AT 5 (at) noon",
])
def test_clean_texts_stay_clean(text):
    assert pii.spans_in(text, ANCHORS) == []


def test_operator(spark):
    docs, given = table(spark, extra=True)
    expected = Counter()
    for doc_id, text in given:
        base = by_patterns(text or "")
        spelt = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, i, k, e) for i, k in enumerate(PATTERNS) for s, e in base[k]))
        expected[doc_id, *[len(base[k]) for k in PATTERNS], hashlib.sha256(spelt.encode()).hexdigest()] += 1
    out = pii.digest(docs).collect()
    assert Counter(tuple(r)[:6] for r in out) == expected
    for r in out:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert any("account" in r.spans for r in out)
    assert pii.digest(documents(spark, empty=True)).collect() == []


def test_redact(spark):
    docs, _ = table(spark, extra=True)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1000] == "write to <EMAIL>, or call <PHONE>."
    assert texts[1005] == 'token = "<ACCOUNT>"'
    assert texts[500] is None and texts[501] == ""
