"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, plus signs,
digits, address schemes and identifier cues.  From each anchor a parser expands to the left and
right as far as its grammar goes, and validates what it has.  Texts are read once; of a stretch
that a parser has read, only the first anchor is expanded.

Four kinds have a fixed grammar and are taken leftmost and without overlap within a kind:

* ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``: four numbers of at most 255 joined by dots
* ``card``: 12 to 19 digits, each two apart by at most a space or hyphen, that pass Luhn's check
* ``phone``: ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

A stretch that fits the grammar but fails validation is dropped and not read again otherwise.

Three more kinds widen them, and never replace one:

* ``mailbox``: an at-sign, plain or spelt ``(at)`` or ``[at]``, between letters of any script,
  with a domain whose dots may be spelt likewise; at most ``MAILBOX`` code points to either side
* ``address``: a URL that names a user or a numbered host (``ssh://ann@host``,
  ``http://10.0.0.1:80``), up to the end of its authority; ``mailto:`` and ``sip:`` with a user,
  ``tel:`` with 7 to 15 digits
* ``account``: what stands behind a cue as ``token = "..."``, ``IBAN: ...`` or ``SSN 123-45-6789``,
  without its quotes.  Secrets have 16 to ``SECRET`` characters with letters and digits,
  IBANs pass modulo 97, social security numbers are 3-2-4, other accounts have 6 to 34
  characters with six digits or more.  A cue in running text without a value is none.

A span of these three that lies within spans of one fixed kind is left out.

Positions count code points, ends are exclusive.  Null texts count as empty and have no spans;
very long texts are read as any other, in time that grows with their length.  Each row is judged
for itself, whether its id is null or repeated or its text occurs again.  An empty table gives no
rows.  Columns of any other name are not read, and ``redact`` hands them on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes

FIXED = ("email", "ip", "card", "phone")
KINDS = (*FIXED, "mailbox", "address", "account")
#: Code points to either side of an at-sign that a mailbox may have.
MAILBOX = 254
SECRET = 512

#: Identifier cues, and what has to follow them.
CUES = {
    "token": "secret", "api_key": "secret", "api-key": "secret", "api key": "secret", "apikey": "secret", "access key": "secret",
    "access_key": "secret", "secret": "secret", "private_key": "secret", "password": "password", "passwd": "password", "passwort": "password",
    "contraseña": "password", "mot de passe": "password", "iban": "iban", "ssn": "ssn", "social security number": "ssn",
    "account": "account", "acct": "account", "konto": "account", "kontonummer": "account", "cuenta": "account", "compte": "account",
    "passport": "account", "customer id": "account", "user id": "account",
}
SCHEMES = ("://", "mailto:", "sip:", "tel:")

ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DIGITS = frozenset("0123456789")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>()|\\,;`{}]*")
_NUMBERED = re.compile(r"(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?\Z")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?\Z")
_USER = re.compile(r"[A-Za-z0-9._%+~-]+(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_TEL = re.compile(r"\+?[0-9(][0-9().-]*[0-9]")
_SPELT_AT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?")
#: Domain labels of any script, joined by a dot that may be spelt.
_ANY_DOMAIN = re.compile(r"[\w-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[\w-]{1,63})+")
_GIVEN = re.compile(r"(?:[\x20\t_-]?(?:number|no\.?|nr\.?|id|code))?[\x20\t]{0,4}(?P<sign>[:=#]|is\b)?[\x20\t]{0,4}[\"'`]?", re.IGNORECASE)
_VALUES = {
    "secret": re.compile(rf"[A-Za-z0-9_+/=.~-]{{16,{SECRET}}}"), "password": re.compile(r"[^\s\"'`<>,;]{6,128}"),
    "ssn": re.compile(r"[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z])"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"), "account": re.compile(r"[A-Za-z0-9](?:[-./]?[A-Za-z0-9]){5,33}(?![A-Za-z0-9])"),
}

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> str:
    """The longest start of the text that passes the check modulo 97; empty if none does."""
    compact = text.replace(" ", "")
    for n in range(len(compact), 14, -1):
        moved = compact[4:n] + compact[:4]
        if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
            ends = [i for i, c in enumerate(text) if c != " "]
            return text[: ends[n - 1] + 1]
    return ""


def automaton() -> ahocorasick.Automaton:
    """All anchors; cues also with a capital, and in capitals."""
    out = ahocorasick.Automaton()
    for sign in ("@", "+", *sorted(DIGITS)):
        out.add_word(sign, (sign if sign in "@+" else "digit", 1))
    for spelt in ("(at)", "[at]", "(AT)", "[AT]"):
        out.add_word(spelt, ("spelt", 4))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper()}:
            out.add_word(form, ("scheme", len(form)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


class Reader:
    """Expands anchors of one text; ``spans`` are those of each kind, in order."""

    def __init__(self, text: str):
        self.text = text
        self.spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
        #: up to where digits have been read as dotted, and as spaced numbers
        self.dotted = self.spaced = 0
        #: up to where at-signs have looked to the left, and what they found there
        self.local_end = 0

    def email(self, at: int) -> None:
        """Left over local characters, not into the address before; right over the domain."""
        text, spans = self.text, self.spans["email"]
        start, least = at, max(self.local_end, spans[-1][1] if spans else 0)
        while start > least and LOCAL.match(text, start - 1):
            start -= 1
        self.local_end = at  # what lies before the sign is of no use to a later one
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            spans.append((start, domain.end()))

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.dotted:
            found = _DOTTED.match(text, at)
            self.dotted = found.end()
            if found.group().count(".") >= 3:
                self.numbers(at, found.group().split("."))
        if at >= self.spaced:
            found = _SPACED.match(text, at)
            self.spaced = found.end()
            if found.end() - at >= 12:
                digits = found.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.spans["card"].append((at, found.end()))

    def numbers(self, at: int, parts: list[str]) -> None:
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                self.spans["ip"].append((at, end))
            at = end + 1

    def phone(self, at: int) -> None:
        found = _DIALLED.match(self.text, at)
        if not found:
            return
        dialled = found.group().rstrip(" ().-")
        if len(dialled) >= 4 and 9 <= sum(c in DIGITS for c in dialled) <= 15:
            self.spans["phone"].append((at, at + len(dialled)))

    def mailbox(self, start: int, end: int) -> None:
        """A sign between letters of any script; the fixed grammar has those of ASCII alone."""
        text = self.text
        first = start
        while first > 0 and start - first < MAILBOX and (text[first - 1].isalnum() or text[first - 1] in "._%+-"):
            first -= 1
        while first < start and text[first] in ".-":
            first += 1
        domain = _ANY_DOMAIN.match(text, end, min(len(text), end + MAILBOX))
        if first < start and domain and domain.group()[-1] not in "-_" and not domain.group().rpartition(".")[2].isdigit():
            self.spans["mailbox"].append((first, domain.end()))

    def scheme(self, start: int, end: int) -> None:
        text, name = self.text, self.text[start:end].lower()
        if name != "://" and start and text[start - 1] in ALNUM:
            return
        if name == "://":
            first = start
            while first > 0 and start - first < 20 and (text[first - 1] in ALNUM or text[first - 1] in "+.-"):
                first -= 1
            while first < start and text[first] not in ALNUM:
                first += 1
            authority = _AUTHORITY.match(text, end).group().rstrip(".")
            user, sign, host = authority.rpartition("@")
            if first < start and text[first] not in DIGITS and ((sign and user and _HOST.match(host)) or _NUMBERED.match(host)):
                self.spans["address"].append((first, end + len(authority)))
            return
        found = (_TEL if name == "tel:" else _USER).match(text, end)
        if found and (name != "tel:" or 7 <= sum(c in DIGITS for c in found.group()) <= 15):
            self.spans["address"].append((start, found.end()))

    def cue(self, start: int, end: int) -> None:
        text = self.text
        kind = CUES.get(text[start:end].lower())
        if kind is None or (start and (text[start - 1].isalnum())) or (end < len(text) and text[end].isalnum()):
            return
        given = _GIVEN.match(text, end)
        # Only values that carry a check of their own may follow without a sign.
        if not given.group("sign") and kind not in ("iban", "ssn"):
            return
        found = _VALUES[kind].match(text, given.end())
        if not found:
            return
        value = found.group()
        if kind == "iban":
            value = iban(value)
        elif kind == "secret":
            value = value.rstrip(".=") if not any(c in DIGITS for c in value) else value.rstrip(".")
            value = value if len(value) >= 16 and any(c in DIGITS for c in value) and any(c.isalpha() for c in value) else ""
        elif kind == "account":
            value = value if sum(c in DIGITS for c in value) >= 6 else ""
        elif kind == "password":
            value = value.rstrip(".!?)") if len(value.rstrip(".!?)")) >= 6 else value
        if value:
            self.spans["account"].append((given.end(), given.end() + len(value)))

    def read(self, anchors: ahocorasick.Automaton) -> dict[str, list[Span]]:
        text = self.text
        for last, (what, length) in anchors.iter(text):
            start = last + 1 - length
            if what == "digit":
                if start >= self.dotted or start >= self.spaced:
                    self.digit(start)
            elif what == "@":
                self.email(start)
                self.mailbox(start, start + 1)
            elif what == "+":
                self.phone(start)
            elif what == "spelt":
                whole = _SPELT_AT.match(text, start - (start > 0 and text[start - 1] == " "))
                if whole:
                    self.mailbox(whole.start(), whole.end())
            elif what == "scheme":
                self.scheme(start, last + 1)
            else:
                self.cue(start, last + 1)
        for kind in KINDS[len(FIXED) :]:
            self.spans[kind] = self.apart(sorted(set(self.spans[kind])))
        return self.spans

    def apart(self, spans: list[Span]) -> list[Span]:
        """Without those that lie in a span of a fixed kind; overlapping ones of a kind as one."""
        out: list[Span] = []
        for start, end in spans:
            if out and start < out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        if not out:
            return out
        fixed = sorted(s for kind in FIXED for s in self.spans[kind])
        kept, at, held = [], 0, 0
        for start, end in out:
            while at < len(fixed) and fixed[at][0] <= start:
                held, at = max(held, fixed[at][1]), at + 1
            if end > held:
                kept.append((start, end))
        return kept


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def spans_in(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)``, sorted."""
    found = Reader(text).read(anchors)
    return sorted((start, k, end) for k, kind in enumerate(KINDS) for start, end in found[kind])


def _anchors() -> ahocorasick.Automaton:
    state = codes.worker_state()
    if "pii" not in state:
        state["pii"] = automaton()
    return state["pii"]


FOUND = "spans array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans, n_email, n_ip, n_card, n_phone, base_sha256, spelt)`` per document.

    ``spans`` are all spans by start, then kind in the order of ``KINDS``, ``spelt`` the same as
    ``kind:start:end`` joined by commas; ``base_sha256`` digests those of the fixed kinds alone.
    """
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        for block in codes.blocks(batches):
            rows = []
            for data in codes.string_column(block.column("text")).cast(pa.large_binary()).to_pylist():
                spans = spans_in((data or b"").decode("utf-8", "replace"), anchors)
                base = [s for s in spans if s[1] < len(FIXED)]
                many = [sum(s[1] == k for s in base) for k in range(len(FIXED))]
                digest = hashlib.sha256(_spell(base).encode()).hexdigest()
                rows.append(([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans], *many, digest, _spell(spans)))
            types = [pa.list_(kind_type), *[pa.int64()] * len(FIXED), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            names = ["doc_id", "spans", *[f"n_{kind}" for kind in FIXED], "base_sha256", "spelt"]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names)

    counts = ", ".join(f"n_{kind} bigint" for kind in FIXED)
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(search, f"doc_id bigint, {FOUND}, {counts}, base_sha256 string, spelt string")


def redact(docs: DataFrame, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """The documents with every span replaced by the name of its kind; a null text stays null.

    Overlapping spans are replaced together, under the kind of the first.
    """

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        for block in codes.blocks(batches, text):
            at = block.schema.get_field_index(text)
            out = []
            for data in codes.string_column(block.column(at)).cast(pa.large_binary()).to_pylist():
                out.append(None if data is None else masked(data.decode("utf-8", "replace"), anchors, mask))
            yield block.set_column(at, block.schema.field(at), pa.array(out, block.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)


def masked(text: str, anchors: ahocorasick.Automaton, mask: str) -> str:
    out, done = [], 0
    for start, kind, end in spans_in(text, anchors):
        if start >= done:
            out += [text[done:start], mask.format(KINDS[kind].upper())]
        done = max(done, end)
    return "".join([*out, text[done:]])


def digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, the digest of the fixed kinds and all spans as one string."""
    spelt: Column = F.col("spelt").alias("spans")
    return find(docs, id_column, text).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spelt)
