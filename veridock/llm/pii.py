"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds email, ip, card and phone follow fixed patterns, leftmost and without overlap for each kind; a match that
fails its test is dropped and the search goes on behind it. The method adds IBANs that pass mod 97 and dashed social
security numbers that words nearby make likely. The score starts from the kind, rises with a passed checksum and with
context words close by, and falls with words that speak against; base spans stay whatever their score.

Defined cases: a null text is read as empty, an empty text has no spans, offsets are code points, repeated rows are
scanned alike, spans of different kinds may overlap, and every scan is linear in the text's length. Other columns of the
input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veridock.llm.common import arrow_map, id_and_text, table
from veridock.llm.spans import Digest, Redact, Spans, digest

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score a kind starts with, and what a passed checksum, a word for it nearby and a word against it add.
PRIOR = {"email": 0.8, "ip": 0.4, "card": 0.5, "phone": 0.5, "iban": 0.5, "ssn": 0.3}
CHECKED, NEAR, AGAINST = 0.2, 0.25, -0.3
#: Characters on either side that count as near, and the score that the method's own kinds need.
REACH, LEAST = 48, 0.5
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "payment", "credit", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
DOUBTS = {"ip": ("version", "release", "section"), "card": ("isbn", "order", "tracking"), "phone": ("isbn", "serial"), "ssn": ("isbn", "part", "serial")}

# A run of digits either fits from its first digit or not at all, so possessive repeats change nothing but the time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans whose checksum fits: of each match the longest one that ends at a blank or at the match's end."""
    found, at = [], 0
    while m := _IBAN.search(text, at):
        end = m.end()
        while end > m.start() and not mod97(text[m.start() : end]):
            end = text.rfind(" ", m.start(), end)
        if end > m.start():
            found.append((m.start(), end))
        at = end if end > m.start() else m.start() + 1
    return found


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def score(kind: str, text: str, start: int, end: int, checked: bool) -> float:
    near = set(_WORD.findall(text[max(0, start - REACH) : start].lower())) | set(_WORD.findall(text[end : end + REACH].lower()))
    total = PRIOR[kind] + CHECKED * checked + NEAR * any(w in near for w in WORDS[kind]) + AGAINST * any(w in near for w in DOUBTS.get(kind, ()))
    return min(1.0, max(0.0, total))


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), kind by kind."""
    found = [("email", s, e, False) for s, e in emails(text)]
    found += [("ip", m.start(), m.end(), False) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end(), True))
    if "+" in text:
        found += [("phone", m.start(), m.end(), False) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    spans = [(kind, s, e, score(kind, text, s, e, checked)) for kind, s, e, checked in found]
    own = [("iban", s, e, True) for s, e in ibans(text)]
    own += [("ssn", m.start(), m.end(), False) for m in _SSN.finditer(text)]
    return spans + [x for kind, s, e, checked in own if (x := (kind, s, e, score(kind, text, s, e, checked)))[3] >= LEAST]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, value, score."""
    return arrow_map(id_and_text(docs, id_col, text_col), Spans(scan, KINDS), Spans.schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with each span replaced by its kind in brackets."""
    return arrow_map(docs, Redact(scan, KINDS, text_col), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), Digest(scan, BASE, KINDS))


QUERIES = {"op8_pii": op8_pii}
SQL: dict[str, str] = {}
