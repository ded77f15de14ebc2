"""Personal data (operator 5).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for account
numbers), and words near a span raise or lower its score.  Spans of the four base kinds are
always reported; spans of the further kinds need ``REPORT`` or more.

Null texts count as empty and have no spans; duplicated rows are searched alike; extra columns
are ignored; an empty table gives an empty result.  All expressions run in linear time, so very
long texts and very long runs of one character are safe.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.spans import Span, as_text, digest, in_order
from truthloom.llm.words import chunks

# The base kinds.
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn")
KINDS = BASE + MORE
REPORT = 0.5
#: Code points on both sides of a span in which context words count.
NEAR = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


@dataclass(frozen=True)
class Context:
    """Score of a span before its neighbours are looked at, and the words that change it."""

    start: float
    up: frozenset[str] = field(default_factory=frozenset)
    down: frozenset[str] = field(default_factory=frozenset)


CONTEXT = {
    "email": Context(0.9, frozenset({"mail", "email", "contact", "write"}), frozenset({"example", "noreply"})),
    "ip": Context(0.6, frozenset({"ip", "address", "host", "server", "login"}), frozenset({"version", "release", "v"})),
    "card": Context(0.8, frozenset({"card", "visa", "mastercard", "credit", "pay", "cvv"}), frozenset({"isbn", "order", "serial"})),
    "phone": Context(0.6, frozenset({"phone", "tel", "call", "mobile", "fax"}), frozenset({"score", "ratio"})),
    "iban": Context(0.8, frozenset({"iban", "account", "bank", "konto", "compte", "cuenta"}), frozenset({"serial", "part"})),
    "ssn": Context(0.3, frozenset({"ssn", "social", "security"}), frozenset({"serial", "part", "order"})),
}
STEP = 0.3
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number has remainder 1, its first four characters moved to the end."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(char, 36)) for char in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping; each search begins at an @ and looks to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _plausible(kind: str, match: re.Match) -> bool:
    found = match.group()
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = _digits(found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    return True


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's own score, moved by the words around the span."""
    rule = CONTEXT[kind]
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = set(_WORD.findall(near.lower()))
    return max(0.0, min(1.0, rule.start + STEP * bool(words & rule.up) - STEP * bool(words & rule.down)))


def find(text: str) -> list[tuple[Span, float]]:
    """All spans with their scores, in order."""
    spans: list[Span] = [("email", *s) for s in emails(text)]
    for kind, pattern in (("ip", IP), ("card", DIGITS), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN)):
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if _plausible(kind, m)]
    scored = {s: score(s[0], text, s[1], s[2]) for s in spans}
    return [(s, scored[s]) for s in in_order(spans, KINDS) if s[0] in BASE or scored[s] >= REPORT]


_SIGN = re.compile(r"[@0-9]")  # every kind has one of these


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of base kinds, their digest, all spans and the greatest score."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = [find(text) if text and _SIGN.search(text) else [] for text in part.column("text").to_pylist()]
                plain = [[span for span, _ in row] for row in rows]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    **{f"n_{k}": pa.array([sum(s[0] == k for s in row) for row in plain], pa.int64()) for k in BASE},
                    "base_sha256": pa.array([digest(as_text(s for s in row if s[0] in BASE)) for row in plain], pa.string()),
                    "spans": pa.array([as_text(row) for row in plain], pa.string()),
                    "scores": pa.array([",".join(f"{s:.1f}" for _, s in row) for row in rows], pa.string()),
                })

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, schema)
