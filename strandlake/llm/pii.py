"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

The base kinds are reported whenever their pattern and check hold; the score says how
sure they are. Spans of the further kinds (iban, national id) are reported only from
MIN_SCORE on, so that context decides on them.

Every pattern is matched so that its time is in proportion to the text. Results are
those of the leftmost non-overlapping matches of the patterns as written in BASE.

Defined results: a null text counts as empty and has no spans; null ids pass through;
equal rows give equal rows; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

#: The base kinds in order, as the contract writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = ("iban", "id")
KINDS = (*BASE, *FURTHER)

#: Score of a span by kind before context, and words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "id": 0.3}
RAISING = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "id": ("ssn", "social", "security", "passport", "national", "id"),
}
LOWERING = ("example", "sample", "test", "version", "dummy", "isbn", "order")
CONTEXT = 40
STEP = 0.3
MIN_SCORE = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")
_NO_DIGIT = str.maketrans("", "", " -().+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of bank account numbers: letters count from 10, the first four signs go last."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each domain's local part is the run before its @, as far as no earlier match holds it."""
    last = 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < domain.start():
            last = domain.end()
            yield start, last


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].translate(_NO_DIGIT)) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_NO_DIGIT)) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    for m in _ID.finditer(text):
        yield "id", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()))
    score = SCORES[kind] + STEP * (not near.isdisjoint(RAISING[kind])) - STEP * (not near.isdisjoint(LOWERING))
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str | None) -> list[Span]:
    """The spans of a text, by kind in the order of KINDS and then by place; ends are exclusive."""
    found = [Span(*m, _score(text, *m)) for m in _matches(text or "")]
    return [s for s in found if s.kind in BASE or s.score >= MIN_SCORE]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and all spans with their scores, for each row of docs."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [[s._asdict() for s in find(text)] for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": spans})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(batches, SCHEMA)


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """doc_id and the text with every span replaced by its kind; of overlapping spans the first counts."""

    def replaced(text: str | None) -> str | None:
        out, last = [], 0
        for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
            if s.start >= last:
                out += [text[last : s.start], mark.format(s.kind)]
                last = s.end
        return text if text is None else "".join([*out, text[last:]])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [replaced(t) for t in frame["text"]]})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(batches, "doc_id long, text string")
